import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sessionloom.llm import divergence, oracles, runs

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    """Every kept term at every group, in Python's whole numbers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(ASCII))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, source in groups:
        terms = sorted(t for t, n in docs[lang].items() if n >= least)
        of_lang = Counter()
        for (other, _), c in counts.items():
            if other == lang:
                of_lang.update(c)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in terms) + len(terms)) for t in terms}
        own, q = p(counts[lang, source]), p(of_lang)
        f = lambda a, b: (a - b) * (a - b) // b
        pairs = [(sum(f(own[t], r[t]) for t in terms), s) for x, s in groups if x == lang and s != source for r in [p(counts[x, s])]]
        said = [(f(own[t], q[t]), t) for t in terms if counts[lang, source][t] and own[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", said, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def rows_of(rng):
    words = [a + b for a in "abcdefgh" for b in ("x", "Y", "é", "中")] + ["the"] * 20
    rows = [(rng.choice("de"), f"s{rng.randrange(6)}", " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(150)]
    rows += [("d", f"s{i % 3}", "one hot text of many copies the the") for i in range(120)]
    rows += [("e", None, "null source xx"), (None, "s1", "ax ax"), (None, None, None), ("z", "alone", "ax"), ("z", "other", ""), ("one", "only", "ax ax ax")] * 3
    return rows + [("d", "long", "the quick, " * 30_000 + "zz " * 5)]


def test_against_brute_force(spark):
    import random

    rows = rows_of(random.Random(2))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, gid string, rank int").repartition(5)
    found = [tuple(r) for r in divergence.audit_sources(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert divergence.audit_sources(docs.limit(0)).collect() == []
    few = divergence.audit_sources(docs, top=2).where("part = 'term'")
    assert few.agg({"rank": "max"}).first()[0] == 2
    # each text of a language once, however many hold it
    texts = divergence.collapsed(docs.selectExpr("hash(lang) as lid", "hash(lang, source) as gid", "coalesce(text, '') as text"))
    assert texts.count() == len({(x, t) for x, _, t in rows if t})


def test_sql_agrees(spark):
    import random

    rows = rows_of(random.Random(3))
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert {(a, b, c, d, e, f) for a, b, c, d, e, f in con.execute(oracles.SOURCE_AUDIT).fetchall()} == brute(rows)


@pytest.mark.parametrize("size", [3, 17, 1000])
def test_words_in_pieces(size):
    import pyarrow as pa

    texts = ["Ab c ab é中 x", None, "", " zz zz! a1b", "中" * 10 + " " + "aB " * 50, "q" * 100 + " w " + "é" * 40]
    found = [Counter() for _ in texts]
    for at, _, text, codes, times, words in runs.word_counts(pa.array(texts), lambda d: divergence.TERM[d], size):
        for a, b, n in zip(text, codes, times, strict=True):
            found[at + a][words[b].as_py()] += int(n)
    assert found == [Counter(TERM.findall((t or "").translate(ASCII))) for t in texts]
