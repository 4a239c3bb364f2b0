import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import secrets as S

ASSIGN = re.compile(r"(?ia:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")


def brute_base(text):
    """(start, kind, end) of the patterns over characters, by re."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def brute_random(texts, least=20, rate=0.01):
    """Spans called random, each text's, by plain loops over characters and sorting all p-values of a stratum."""
    found = [sorted({(m.start(), m.end()) for p in ("[A-Za-z0-9+/]+", "[A-Za-z0-9_-]+") for m in re.finditer(p, t) if m.end() - m.start() >= least and ("+/" in p or re.search("[-_]", m.group()))}) for t in texts]
    pairs = Counter()
    for text, spans in zip(texts, found, strict=True):
        inside = {i for a, b in spans for i in range(a, b)}
        pairs.update((a, b) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)) if a in S.CHARACTERS and b in S.CHARACTERS and not {i, i + 1} & inside)
    sort = lambda c: "0" if c in S.DIGITS else "a" if c in S.SMALL else "A" if c in S.LARGE else "+"
    tail = lambda z: math.log10(max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300)) if z > -35 else (-z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))) / math.log(10)
    strata = {}
    for r, (text, spans) in enumerate(zip(texts, found, strict=True)):
        for a, b in spans:
            t, n = text[a:b], b - a
            name = next((e for e, own in S.ENCODINGS.items() if set(t) <= set(own)), None)
            if name is None or not re.search("[A-Za-z]", t):
                continue
            own = S.ENCODINGS[name]
            k, m = len(own), Counter(t)
            one = Counter({c: 1.0 for c in own})
            for (x, y), v in pairs.items():
                if x in own and y in own:
                    one[x] += v
                    one[y] += v
            share = {c: one[c] / sum(one.values()) for c in own}
            seen = sum(v for (x, y), v in pairs.items() if x in own and y in own)
            joint = {(x, y): (pairs[x, y] + k * k * share[x] * share[y]) / (seen + k * k) for x in own for y in own}
            left, right = Counter(), Counter()
            for (x, y), v in joint.items():
                left[x] += v
                right[y] += v
            tie = {(x, y): math.log(v / (left[x] * right[y])) for (x, y), v in joint.items()}
            mean = sum(v * tie[c] for c, v in joint.items())
            spread = math.sqrt(max(1e-12, sum(v * tie[c] ** 2 for c, v in joint.items()) - mean**2))
            near = list(zip(t, t[1:], strict=False))
            chi2 = k / n * sum(v * v for v in m.values()) - n
            value = {c: (i - (k - 1) / 2) / math.sqrt((k * k - 1) / 12) for i, c in enumerate(own)}
            whole, part = Counter(map(sort, own)), Counter(map(sort, t))
            kinds = sum((part[c] - n * v / k) ** 2 / (n * v / k) for c, v in whole.items())
            bent = lambda x, df: ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
            z = [bent(chi2, k - 1), max(bent(kinds, len(whole) - 1), 0), (2 * sum((value[x] > 0) != (value[y] > 0) for x, y in near) - n + 1) / math.sqrt(n - 1), sum(value[x] * value[y] for x, y in near) / math.sqrt(n - 1)]
            s2, s3, two = sum(v**2 for v in share.values()), sum(v**3 for v in share.values()), n * (n - 1) / 2
            equal = tail((sum(v * (v - 1) for v in m.values()) / 2 - two * s2) / math.sqrt(two * (s2 - s2 * s2) + two * 2 * (n - 2) * (s3 - s2 * s2)))
            rate0, seen0 = sum(v for (x, y), v in joint.items() if sort(x) != sort(y)), sum(sort(x) != sort(y) for x, y in near) / (n - 1)
            change = 0.0
            if seen0 > rate0:
                inner = min(seen0, 1 - 1e-12)
                change = -(n - 1) * (inner * math.log(inner / rate0) + (1 - inner) * math.log((1 - inner) / (1 - rate0))) / math.log(10)
            tied = tail((sum(tie[c] for c in near) - (n - 1) * mean) / (spread * math.sqrt(n - 1)))
            level = math.floor(-((equal + change + tied) / 3 + math.log10(math.e)) * S.STEPS) if max(map(abs, z)) <= 3 else 0
            strata.setdefault((name, int(math.log2(n))), []).append((max(level, 0), r, a, b))
    out = [[] for _ in texts]
    for tests in strata.values():
        tests.sort(reverse=True)
        passed = [i for i, x in enumerate(tests) if 10 ** (-x[0] / S.STEPS) * len(tests) <= rate * sum(y[0] >= x[0] for y in tests)]
        for level, r, a, b in tests[: max(passed, default=-1) + 1]:
            if level > 0 and not any(x < b and a < y for x, _, y in brute_base(texts[r])):
                out[r].append((a, 3, b))
    return out


def texts_with_secrets(rng):
    words = ["the", "of", "Running", "house", "green", "Tree", "walked", "2024", "x1"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    drawn = lambda own, n: "".join(rng.choice(S.ENCODINGS[own]) for _ in range(n))
    out = [prose(40) for _ in range(60)]
    out += [f"é中 {prose(5)} {drawn(e, rng.choice((20, 24, 33, 40, 64)))} {prose(5)}" for e in S.ENCODINGS for _ in range(4)]
    out += [f"{k}{s}{v}" for k in ("Password", "API_KEY", "apikey", "toKen", "secret", "paſſwd", "toKen") for s in ("=", '": "', " : ", ":=", " ") for v in ("abc12", "abc123", "tok=en.-")]
    out += ["AKIA" + "A" * 15, "éAKIA" + "A1" * 8, "AKIA" + "Z9" * 30, "AKIAAKIA" * 3, "f" * 23, "f" * 24, "中" + "0a" * 14, "secret secret: token=abcdefg token: ", "a" * 25 + "G"]
    out += ["correcthorsebatterystaplepurple", "https://example.org/articles/2024/some-long-title-of-a-page", "snake_case_identifier_name_of_length", "0123456789abcdef0123456789abcdeF", "12345678901234567890123", "- - -", "", None]
    return [*out, prose(20) * 3000 + " " + drawn("base62", 40), drawn("base64", 30_000), out[70]]


def test_against_brute_force(spark, monkeypatch):
    texts = texts_with_secrets(random.Random(5))
    rows = [(None if i == 3 else i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    found = {r.doc_id: r for r in S.find_secrets(docs).collect()}
    plain = [t or "" for t in texts]
    extra = brute_random(plain)
    assert sum(map(len, extra)) > 20
    for i, text in enumerate(plain):
        r, base = found[None if i == 3 else i], brute_base(text)
        shown = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert r.spans == shown(base + extra[i]), (i, text[:80])
    called = "".join(r.spans for i, r in found.items() if i is not None and i < 60)
    assert called == ""  # prose alone
    assert S.find_secrets(docs.limit(0)).collect() == []


def test_random_runs_are_found_and_ordinary_ones_left(spark):
    rng = random.Random(8)
    texts = texts_with_secrets(rng)[:60] + ["".join(rng.choice(S.ENCODINGS["base62"]) for _ in range(32)) for _ in range(50)] + ["someOrdinaryIdentifierOfGreatLength", "anotherlongwordwithoutanyblanks"] * 10
    found = S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    held = {r.doc_id for r in found if "random" in r.spans}
    assert len(held & set(range(60, 110))) >= 48 and not held - set(range(60, 110))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_against_patterns(spark):
    from sessionloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op12_secrets"](spark, folder).collect():
        base = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in base.split(",") if s]


def test_normal_tail():
    z = np.array([0.0, -1.0, -5.0, -34.9, -35.1, 3.0])
    got = S.log10_tail(z)
    assert abs(got[0] - math.log10(0.5)) < 1e-12 and abs(got[3] - got[4]) < 5 and (np.diff(got[:5]) < 0).all()
