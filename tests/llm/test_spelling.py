import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import spelling

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least_length=6, least_count=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def one_apart(a, b):
    """Whether one letter inserted, deleted or replaced turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, **settings):
    n = brute_words(rows, **settings)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def rows_of(rng):
    letters = "abcnéÀ÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 14))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aabbaabb", "abcdefghijklmnopqrstuvwxyz", "é" * 9, "x" * 70 + "y" * 30]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = stems[min(len(stems) - 1, int(rng.expovariate(0.2)))]
            for _ in range(rng.randrange(3) if rng.random() < 0.2 else 0):
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]))
            words.append(rng.choice((w, w.upper(), w.title())))
        rows.append((i, rng.choice((" ", "1", "中 ", "_")).join(words)))
    long = "abcdé" * 6000
    rows += [(2, "gardens " * 250 + "gardenz " * 50 + "gardenzz " * 10)]
    return [*rows, (None, "catenas catenas"), (None, None), (7, ""), (5, "catenas " * 9)] + [(-3, f"{long} {long[1:]} {long}x {long[:300]}q{long[300:]}")] * 5 + rows[:2]


def test_against_brute_force(spark):
    rows = rows_of(random.Random(1))
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n int, word string").repartition(5)
    chains = 0
    for every in (7, 199):
        found = spelling.spelling_variants(docs, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect()
        chains += sum(r.form not in (None, r.root) for r in found)
        assert len(found) == len({r.word for r in found}) and {tuple(r) for r in found} == brute(rows, every=every)
    assert chains  # forms of forms
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_checksums(seed):
    rng = random.Random(seed)
    items = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 3, 47, 48, 49, 200)))) for _ in range(60)]
    leads = [f"{rng.randrange(10**6)}:".encode() for _ in items]
    size = np.array([len(x) for x in items])
    states = np.array([zlib.crc32(x) for x in leads], np.uint32)
    got = spelling.crc32_each(states, np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(leads, items, strict=True)]


def test_nodes_are_told_apart():
    words = ["".join(random.Random(i).choice("abéÿz") for _ in range(i % 90)) for i in range(300)]
    names = {}
    for w in words:
        for depth, node in enumerate(spelling.node_names(w)):
            assert names.setdefault(node, w[:depth]) == w[:depth]
    assert max(n for n, _ in names if n is not None) < spelling.FAN**spelling.DEPTH < 1 << 63
