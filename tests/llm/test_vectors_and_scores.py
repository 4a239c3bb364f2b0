import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import ann, embedding_dedup, quality, toxicity
from sessionloom.llm.common import connected_components

ROW = "vec_id long, embedding array<float>, label int"
ODD = [(None, [1.0, 0.0, 0.0, 0.0], 0), (9001, None, 0), (9002, [0.0] * 4, 0), (9003, [float("nan"), 1.0, 0.0, 0.0], 0), (9004, [None, 1.0, 0.0, 0.0], 0), (9005, [float("inf"), 0.0, 0.0, 0.0], 0)]


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 4))
    near = base[rng.integers(0, len(base), n // 3)] + rng.normal(size=(n // 3, 4)) * 0.05
    return np.concatenate([base, near, base[: n - 2 * (n // 3)], base[:1].repeat(20, 0)]).astype(np.float32)


def test_near_vectors_are_exact(spark, monkeypatch):
    v = vectors(150)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    for tree_rows, cost in ((2048, 4096), (40, 4096), (20, 0)):  # one block, blocks of one cell, many cells
        monkeypatch.setattr(embedding_dedup, "TREE_ROWS", tree_rows)
        monkeypatch.setattr(embedding_dedup, "COPY_COST", cost)
        found = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + ODD, ROW)).where("vec_id is not null").collect()}
        unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
        link = unit @ unit.T >= 0.95
        np.fill_diagonal(link, False)
        label = np.arange(len(v))
        for _ in v:
            label = np.array([min([label[i], *label[link[i]]]) for i in range(len(v))])
        assert [found[i].n_links for i in range(len(v))] == link.sum(1).tolist()
        assert [found[i].component_id for i in range(len(v))] == label.tolist()
        assert all(found[i].n_links == 0 and found[i].kept for i in range(9001, 9006))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], ROW)).count() == 0


def test_nearest_neighbours(spark):
    v = vectors(900, 1)
    rows = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)] + ODD, ROW)
    found = ann.nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), list_rows=32).toPandas()
    hit = total = 0
    for q, own in found.groupby("query_id"):
        d = np.sqrt(((v.astype(float) - v[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(v)), d)) if i != q][:10]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], atol=1e-12) and q not in set(own.vec_id)
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        hit, total = hit + len(set(order) & set(own.vec_id)), total + 10
    assert hit / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], 0), (1, [1.0, 0.0, 0.0, 0.0], 0), (2, [0.0, 1.0, 0.0, 0.0], 0)], ROW)
    assert [(r.vec_id, r["rank"]) for r in ann.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest_neighbours(few.limit(0), few).count() == 0


def test_cells_follow_what_they_prune():
    rng = np.random.default_rng(2)
    alike = embedding_dedup.units(rng.normal(size=(2000, 64)))
    centers = rng.normal(size=(200, 64))
    apart = embedding_dedup.units(centers[rng.integers(0, 200, 2000)] + 0.1 * rng.normal(size=(2000, 64)))
    counts = [embedding_dedup.cells(x, embedding_dedup.pivots(x, 300), 1_000_000, 0.32) for x in (alike, apart)]
    assert counts[0] <= 8 and counts[1] >= 128
    tops = embedding_dedup.pivots(apart, 200)
    d, gaps = embedding_dedup.spans(apart, tops), embedding_dedup.spans(tops, tops) + np.eye(len(tops))
    radii = np.array([d[d.argmin(1) == c].min(1).max() for c in range(len(tops))])
    assert embedding_dedup.visits(d, gaps, radii, 0.32).sum(1).mean() < 1.2


def test_the_index_grows_with_the_root_of_the_rows_and_prunes_clusters():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(300, 32))
    points = centers[rng.integers(0, 300, 12_000)] + 0.3 * rng.normal(size=(12_000, 32))
    own = ann.balanced_centroids(points[:1700], 100, 1)
    graph, boundary = ann.CentroidGraph.build(own), ann.tuned_boundary(points[:1700], own, 0.4)
    ratio = ann.tuned_ratio(points[:1700], graph, ann.lists_of(points[:1700], own, 4, boundary), 12_000, 10, 0.97)
    held = ann.lists_of(points, own, 4, boundary)
    assert 1 < np.mean([len(h) for h in held]) < 3
    lists = [np.array([i for i, h in enumerate(held) if c in h]) for c in range(100)]
    hit, scanned = 0, 0
    for q in range(0, 12_000, 400):
        near, d, many = graph.search(points[q], ratio)
        assert (np.diff(d) >= 0).all()
        found = np.unique(np.concatenate([lists[c] for c in near[:many]]))
        away = ((points - points[q]) ** 2).sum(1)
        hit += len(set(np.argsort(away)[:11]) & set(found))
        scanned += len(found)
    assert hit / 330 >= 0.88 and scanned / 30 / 12_000 < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 101), (7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(spark):
    rng = np.random.default_rng(3)
    plain, bad = [f"word{c}" for c in "abcdefghijkl"], ["scum", "trash", "idiot"]
    docs, labels = [], []
    for i in range(400):
        toxic, good = i % 4 == 0, i % 5 != 1
        words = rng.choice(plain, 40).tolist()
        if toxic:
            words[5:25:5] = rng.choice(bad, 4).tolist()
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", f"s{i % 3}", len(text), "clash"))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, None, None, None, ""), (1001, "", "en", "s", 0, ""), (None, "plain words", "en", "s", 9, ""), (1002, "trash " * 9000, "en", "s", 9, "")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels + [(5000, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in held) for i in range(400))
    assert np.mean([found[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1002].predicted == 1 and found[1000].predicted == found[1001].predicted == 0
    assert all(e.doc_id not in held for r in found.values() for e in r.evidence)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def plain_terms(text):
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
    return words + [b"^" + w[:5] for w in words if len(w) > 5]


def test_terms_are_those_of_the_text():
    texts = ["Ab abcdef, abcdeg x1y ÉÉé", None, "", "a" * 9000 + " b"]
    for (_, _, text, hashes, counts) in toxicity.text_terms(pa.array(texts)):
        assert [sorted(counts[text == i].tolist()) for i in range(4)] == [sorted(Counter(plain_terms(t)).values()) for t in texts]
        assert len(set(hashes.tolist())) == len({t for x in texts for t in plain_terms(x)})


def test_toxicity_weighs_all_terms(spark):
    """Neighbours by exact cosine over all terms: rare toxic words, rows without a telling term and terms that no example holds count."""
    docs, labels = corpus(spark)
    rare = [(2000 + i, f"quoz{c} blent{c} vark{c} worda", "en", "s", 9, "") for i, c in enumerate("abcdefghij")]
    rare += [(3000 + i, f"quoz{c} blent{c} vark{c} unheard{c}", "en", "s", 9, "") for i, c in enumerate("abcdefghij")]
    docs = docs.union(spark.createDataFrame(rare, docs.schema))
    labels = labels.union(spark.createDataFrame([(2000 + i, 1, 1) for i in range(10)], labels.schema))
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    texts = {r.doc_id: plain_terms(r.text) for r in docs.collect()}
    df = Counter(t for r in docs.collect() for t in set(plain_terms(r.text)))
    weigh = lambda d: {t: (1 + np.log(c)) * (np.log((1 + len(found)) / (1 + df[t])) + 1) for t, c in Counter(texts[d]).items()}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    used = [i for i in [*range(400), *range(2000, 2010)] if zlib.crc32(str(i).encode()) % 5]
    for d in [3000, 3001, 7, 8, 1002, *(3000 + i - 2000 for i in used if i >= 2000)]:
        own = weigh(d)
        want = sorted((sum(x * own.get(t, 0) for t, x in v.items()) / size(v) / size(own) for v in map(weigh, used)), reverse=True)[:15]
        assert np.allclose([e.cosine for e in found[d].evidence], [w for w in want if w > 0], atol=1e-9)
    for i in used:
        if i >= 2000:
            assert found[i + 1000].evidence[0].doc_id == i and found[i + 1000].evidence[0].toxic == 1


def test_toxicity_scores_by_brute_force(spark):
    """The whole score of every row: all pairs of cosines, votes, and the fit over the examples each left out in turn."""
    docs, labels = corpus(spark)
    texts = {r.doc_id: plain_terms(r.text) for r in docs.collect()}
    df = Counter(t for own in texts.values() for t in set(own))
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    rate = sum(y.values()) / len(y)
    z = {}
    for t in {t for d in y for t in texts[d]}:
        n, bad = sum(t in texts[d] for d in y), sum(t in texts[d] for d in y if y[d])
        z[t] = (bad - rate * n) / np.sqrt(rate * (1 - rate) * n + 1e-9) if bad >= 3 else 0
    telling = {t for t in z if z[t] > 3}

    def vector(own):
        raw = {t: (1 + np.log(c)) * (np.log((1 + len(texts)) / (1 + df[t])) + 1) for t, c in Counter(own).items()}
        size = np.sqrt(sum(x * x for x in raw.values()))
        return {t: x / size for t, x in raw.items()}

    whole = {d: vector(own) for d, own in texts.items()}
    few = {d: vector([t for t in own if t in telling]) for d, own in texts.items()}

    def vote(of, d):
        cosines = sorted((-round(sum(x * of[d].get(t, 0) for t, x in of[e].items()), 12), e) for e in y if e != d or d not in fitted)
        near = [(min(-c, 1.0), y[e]) for c, e in cosines[:15] if c < 0]
        weights = [1 / (np.sqrt(max(2 - 2 * c, 0)) + 0.1) for c, _ in near]
        return sum(w * t for w, (_, t) in zip(weights, near, strict=True)) / max(sum(weights), 1e-12), bool(near)

    def features(d):
        (v, some), (u, _) = vote(whole, d), vote(few, d)
        hits, distinct = sum(t in telling for t in texts[d]), len(few[d])
        return [v, v * v, u, u * u, np.log1p(hits), u * np.log1p(hits), u * distinct, 1.0], some

    fitted = set(y)  # an example isn't its own neighbour while the score is fitted
    held = [(features(d), y[d]) for d in y]
    x, want = np.array([f for (f, some), _ in held if some]), np.array([t for (_, some), t in held if some], float)
    w, ridge = np.zeros(8), np.diag([1.0] * 7 + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - want) + ridge @ w)
    fitted = set()
    alone = [t for (_, some), t in held if not some]
    base = (sum(alone) + 0.1) / (len(alone) + 10)
    for r in toxicity.score_toxicity(docs, labels).collect():
        if r.doc_id in (1002, 1000, 1001, None) or r.doc_id % 9 == 0:
            f, some = features(r.doc_id)
            score = 1 / (1 + np.exp(-np.clip(np.array(f) @ w, -30, 30))) if some else base
            assert abs(r.score - score) < 1e-6, (r.doc_id, r.score, score)


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.15)
    dense = dense[dense.any(1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    at, terms = np.nonzero(dense)
    sizes, weights = np.bincount(at, minlength=len(dense)), dense[at, terms]
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    index = toxicity.BlockMaxIndex(len(dense), np.bincount(terms, minlength=40), [(0, sizes, terms, weights)])
    ids, cosines, _ = index.nearest(sizes, terms, weights, 7, np.arange(len(dense)))
    want = dense @ dense.T
    np.fill_diagonal(want, 0)
    assert np.allclose(cosines, -np.sort(-want, axis=1)[:, :7])
    assert np.allclose(np.take_along_axis(want, ids, 1)[cosines > 0], cosines[cosines > 0])
    grouped = np.kron(np.eye(8), np.ones((16, 5))) + 0.01 * rng.random((128, 40))  # blocks that differ: most are skipped
    grouped /= np.linalg.norm(grouped, axis=1, keepdims=True)
    at, terms = np.nonzero(grouped)
    sizes, weights = np.bincount(at), grouped[at, terms]
    index = toxicity.BlockMaxIndex(128, np.bincount(terms), [(0, sizes[:70], terms[at < 70], weights[at < 70]), (70, sizes[70:], terms[at >= 70], weights[at >= 70])])
    ids, cosines, scored = index.nearest(sizes, terms, weights, 5)
    assert np.allclose(cosines, -np.sort(-(grouped @ grouped.T), axis=1)[:, :5]) and scored <= 0.5


def test_block_max_search_finds_its_bar_behind_empty_promises(monkeypatch):
    """Blocks that promise most hold one common term an example; those after them hold the near ones, which spare all others."""
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "ROWS", 5)
    rng = np.random.default_rng(6)
    dense = np.zeros((64 * 16, 16))
    dense[:64] = np.tile(np.eye(16), (4, 1))
    dense[64:128] = 1 + 0.1 * rng.random((64, 16))
    dense[128:, :8] = 1 + 0.1 * rng.random((56 * 16, 8))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    at, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(len(dense), np.bincount(terms), [(0, np.bincount(at), terms, dense[at, terms])])
    query = np.full(16, 0.25)
    ids, cosines, scored = index.nearest(np.array([16]), np.arange(16), query, 15)
    assert np.allclose(cosines[0], -np.sort(-(dense @ query))[:15]) and set(ids[0]) <= set(range(64, 128)) and scored <= 8 / 64


def test_equal_examples_are_compared_together(monkeypatch):
    """Thousands of ties go to the earlier ones, and their cosines aren't taken one by one."""
    n, gathered = 3000, []
    index = toxicity.BlockMaxIndex(n, np.array([n, n]), [(0, np.full(n, 2), np.tile([0, 1], n), np.tile([0.6, 0.8], n))], np.arange(n)[::-1])
    reduceat = np.add.reduceat
    monkeypatch.setattr(toxicity.np, "add", type("Add", (), {"at": np.add.at, "reduceat": staticmethod(lambda *a: gathered.append(1) or reduceat(*a))}))
    ids, cosines, _ = index.nearest(np.array([2]), np.array([0, 1]), np.array([0.6, 0.8]), 4)
    assert ids.tolist() == [[n - 1, n - 2, n - 3, n - 4]] and np.allclose(cosines, 1) and len(gathered) == -(-n // toxicity.ROWS)


def test_vectors_are_packed_many_at_once():
    """Runs with empty vectors, large steps and large counts come back whole, in any cut of the rows."""
    rng = np.random.default_rng(7)
    sizes = np.array([0, 5, 1, 0, 0, 300, 2, 0])
    terms = np.concatenate([np.sort(rng.choice(1 << 30, n, replace=False)) for n in sizes])
    counts = np.where(rng.random(len(terms)) < 0.9, 1, rng.integers(1, 1 << 30, len(terms)))
    rows = toxicity.packed(sizes, terms, counts)
    assert len(rows) == len(sizes)
    for at, to in ((0, 8), (0, 1), (1, 6), (3, 5), (8, 8)):
        begin, end = sizes[:at].sum(), sizes[:to].sum()
        for found, want in zip(toxicity.unpacked(rows[at:to]), (sizes[at:to], terms[begin:end], counts[begin:end]), strict=True):
            assert found.dtype == np.int64 and np.array_equal(found, want)


def test_quality(spark):
    docs, labels = corpus(spark)
    scored = quality.score_quality(docs, labels, fit_rows=300)
    assert scored.columns == [*docs.columns, "quality_score", "text_score", "metadata_score"]
    found = {r.doc_id: r for r in scored.collect()}
    assert len(found) == 404 and np.mean([(found[i].quality_score >= 0.5) == (i % 5 != 1) for i in range(400)]) > 0.98
    assert found[3].score == "clash" and found[3].text is not None and found[1000].text is None
    assert {r.quality_score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_text_features_against_a_plain_version():
    texts = ["Aa b1 b1 c. c. c.", "", "x y x y x y é!\n", "one"]
    odds = np.linspace(-1, 1, 2 * quality.BUCKETS).astype(np.float32)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts[:-1])])
    found = quality.text_view(data, starts, odds)
    for text, row in zip(texts, found, strict=True):
        raw, words = text.encode(), text.lower().encode().split()
        share = lambda f: sum(map(f, raw)) / max(1, len(raw))
        assert row[0] == pytest.approx(share(lambda b: 65 <= b <= 90)) and row[3] == pytest.approx(share(lambda b: b >= 128))
        assert row[7 + quality.MARKS.index(b".")] == pytest.approx(share(lambda b: b == 46))
        at = quality.KINDS
        seen = lambda items: sum(x in items[:i] for i, x in enumerate(items)) / max(1, len(items))
        assert row[at] == pytest.approx(np.log1p(len(words))) and row[at + 3] == pytest.approx(seen(words))
        assert row[at + 4] == pytest.approx(seen(list(zip(words, words[1:]))))
        hashes = quality.shingles.words(np.frombuffer(raw, np.uint8), np.array([0]))[1]
        own = odds[(hashes % np.uint64(quality.BUCKETS)).astype(int)]
        assert row[-2] == pytest.approx(own.mean() if len(own) else 0, abs=1e-6)


def test_quality_exchanges_sure_labels_over_all_rows(spark):
    """Rounds against plain sums over all unlabelled rows at once."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    m = rng.integers(0, 5, (300, 1)) + np.array([[0, quality.SLOTS, 2 * quality.SLOTS]])
    y = (x[:, 0] > 0).astype(float)
    text, meta = quality.Text.fit(x[:100], y[:100]), quality.Metadata(quality.Metadata.count(m[:100], (m[:100, 0] > 2).astype(int)))
    rows = spark.createDataFrame([(x[i].tolist(), m[i].tolist()) for i in range(100, 300)], "text array<float>, meta array<int>").repartition(3)
    counted, sums, many = quality.exchange(rows, text, meta, 0.8)
    p, q = quality.sigmoid(text.logit(x[100:])), quality.sigmoid(meta.logit(m[100:]))
    sure, told = (p >= 0.8) | (p <= 0.2), (q >= 0.8) | (q <= 0.2)
    assert sure.sum() and told.sum() == many
    assert np.array_equal(counted, quality.Metadata.count(m[100:][sure], (p[sure] >= 0.8).astype(int)))
    assert np.allclose(sums, text.sums(x[100:][told], (q[told] >= 0.8).astype(float)))


def test_quality_of_clashing_names_long_texts_and_repeated_labels(spark):
    docs, labels = corpus(spark)
    named = docs.withColumnRenamed("score", "quality_score").withColumn("scores", F.lit(1)).union(spark.createDataFrame([(1, "w " * 500_000, "en", "s", 1, "mine", 1)] * 3, "doc_id long, text string, lang string, source string, n_chars long, q string, s int"))
    scored = quality.score_quality(named, labels, fit_rows=300, rounds=1)
    assert scored.columns == [*named.columns, "quality_score_", "text_score", "metadata_score"]
    found = scored.where("doc_id = 1 and length(text) > 900000").collect()
    assert len(found) == 3 and len({r.quality_score_ for r in found}) == 1 and found[0].quality_score == "mine"
