import os

import numpy as np
import pytest

import corpus_pipeline
from sessionloom.llm.neardup import near_duplicates
from sessionloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "source_mix", "packing"]
    assert {n.split("_")[0] for n in QUERIES if n.startswith("op")} <= {f"op{i}" for i in range(1, 14)} and "pipeline" in QUERIES


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, DATA)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    repeated = good.union(good.limit(1))
    kept = corpus_pipeline.near_dedup(spark, repeated, DATA).toPandas()
    groups = near_duplicates(good).toPandas()
    assert sorted(kept.doc_id) == sorted(groups[groups.kept].doc_id) and kept.columns.tolist() == docs.columns
    private = corpus_pipeline.personal_data(spark, good, DATA)
    assert private.columns == docs.columns and private.count() == good.count()
    assert private.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").join(good, "doc_id", "left_semi").count()
    assert private.join(good, ["doc_id", "text"], "left_anti").count() > 0
    assert corpus_pipeline.source_mix(spark, good, DATA).columns == docs.columns


def test_near_dedup_goes_by_row(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(80))
    a, b = words("a"), words("b")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b + " more", "x"), (5, b, "y"), (9, "", "x"), (9, None, "x"), (8, b + " and", "x"), (8, b, "x"), (None, b, "x"), (None, b, "x")]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(order, "doc_id int, text string, own_key string").coalesce(1), "")
        assert kept.columns == ["doc_id", "text", "own_key"]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (5, b), (9, ""), (9, None), (None, b), (None, b)], key=repr)
    assert corpus_pipeline.near_dedup(spark, kept.limit(0), "").collect() == []


def test_run_on_odd_rows(spark, tmp_path):
    """All stages over nulls, empty and long texts, repeats and clashing columns; every word the mix takes is packed."""
    rng = np.random.default_rng(6)
    plain = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        words = rng.choice(plain, 30).tolist()
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "en", f"s{i % 3}", 0, "kept", i))
        labels.append((i, int(good), 0))
    rows += [(1000, rows[1][1], "en", "s1", 0, "kept", 1), (1001, rows[1][1] + " more", "en", "s1", 0, "kept", 1), rows[2], rows[2]]
    rows += [(2000, None, None, None, None, "kept", 0), (2001, "", "en", "s", 0, "kept", 0), (None, "word of no id mail ann.lee@mail.example.com", None, None, None, "kept", 0), (2002, " ".join(rng.choice(plain, 30_000).tolist()), "fr", "s1", 0, "kept", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, size int"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, folder, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert docs.columns == [c.split(" ")[0] for c in names.split(", ")]
        seen.append(docs.toPandas())
    good, kept, private, mixed = seen
    ids = set(good.doc_id.dropna().astype(int))
    assert {i for i in range(240) if i % 4} <= ids and not {i for i in range(240) if i % 4 == 0} & ids
    assert (good.quality_score == "kept").all()
    ids = kept.doc_id.dropna().astype(int).tolist()
    assert 1000 not in ids and 1001 not in ids and ids.count(2) == ids.count(1) == 1
    assert len(private) == len(kept) and not private.text.str.contains("ann.lee@mail", na=False).any()
    out = corpus_pipeline.packing(spark, docs, folder).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and len(out[out.piece == 0]) == len(mixed)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all()
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert len(whole[whole.piece == 0]) > 150 and set(whole.doc_id.dropna()) <= set(mixed.doc_id.dropna()) | set(kept.doc_id.dropna())
