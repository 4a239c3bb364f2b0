import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import mixing, neardup, packing, quality, shingles
from sessionloom.llm.common import BATCH_BYTES, BATCH_SETTING
from sessionloom.llm.queries import tokenizer_file

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor ".split()


def texts(n, words):
    return pa.array([" ".join(WORDS[(i * j + j * j) % len(WORDS)] for j in range(words)) for i in range(n)])


def test_workers_hold_a_part_of_their_texts():
    column, odds = texts(1000, 600), np.zeros(2 * quality.BUCKETS, np.float32)
    assert column.nbytes > 3_500_000
    for work in (lambda data, starts: quality.text_view(data, starts, odds), lambda data, starts: shingles.superminhash(shingles.shingle_sets(data, starts), 96)):
        tracemalloc.start()
        for _, _, data, starts in shingles.text_chunks(column):
            work(data, starts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6


def test_chunks_do_not_change_what_is_found():
    column = pa.array([*texts(40, 50).to_pylist(), None, "", "Ünï " * 4000, *texts(5, 3000).to_pylist()])
    found = []
    for size in (1, 20_000, 10_000_000):
        found.append([s.tolist() for _, _, data, starts in shingles.text_chunks(column, size) for s in shingles.shingle_sets(data, starts)])
    assert len(found[0]) == len(column) and found[0] == found[1] == found[2]


@pytest.mark.parametrize("use", ["quality", "near_dedup", "packing"])
def test_texts_go_to_python_in_bounded_batches(spark, use):
    spark.conf.unset(BATCH_SETTING)
    docs = spark.range(0, 8000, 1, 1).selectExpr("id as doc_id", "repeat('abcdefghi ', 300) as text", "'s' as source", "'en' as lang")
    if use == "quality":
        quality.score_quality(docs.limit(3), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    elif use == "near_dedup":
        neardup.near_groups(docs.limit(3))
    else:
        packing.token_pieces(docs.limit(3), tokenizer_file("byte_bpe_50k.json"), 2048, 0)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    seen = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in seen) == 8000 and max(r.bytes for r in seen) < 2 * BATCH_BYTES
    spark.conf.set(BATCH_SETTING, "32m")
    packing.token_pieces(docs, "", 2048, 0)
    assert spark.conf.get(BATCH_SETTING) == "32m"  # a bound of the session's own stays
    spark.conf.unset(BATCH_SETTING)


def test_mix_starts_no_python_workers(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i + 1), "xyz"[i % 3] if i % 7 else None) for i in range(40)], "doc_id long, text string, source string").repartition(2)
    path = f"{mixing.materialize(docs, 'mix').inputFiles()[0].rpartition('/')[0]}"
    mixed = mixing.take_mix(spark.read.parquet(path))
    assert "ExistingRDD" not in mixed._jdf.queryExecution().toString()
    assert mixed.count() > 0
    assert mixing.take_mix(docs.limit(0)).count() == 0
