import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.llm import packing, token_files, tokens
from sessionloom.llm.tokens import PieceEncoder, RankEncoder

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.1"
SOME = ["İx ŉ ſ ª²½ ÀÉ\xa0é", "\x01 a\x01 \x01", "", "a  b", " a", "a ", "\n", "a\n\nb", "x\t \ty", "x.. y", " . y", "x. ", "x.\ny. z, a", "_. a", "it's 'S We'll\n\n  don't 123 45!?", "é ́ İ ΣAΣ <|endoftext|> x<|endoftext|>y", "a\x1cb\x85c　 e\0. f", "日本語 текст, да. Ok"]
TEXT = st.text(alphabet=st.sampled_from(list("abAÉß19.,'!_ \n\t\x1c\x85　яΣ\0")), max_size=40)
DOCS = "doc_id long, text string, score string"


def library(name):
    return tokenizers.Tokenizer.from_file(str(P.path(name)))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_are_those_of_the_library(texts):
    texts = SOME + texts
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    global _r, _w
    try:
        _r
    except NameError:
        _r, _w = RankEncoder(str(P.path("byte_bpe_50k.json"))), PieceEncoder(str(P.path("word_bpe_49k.json")))
    for x, by, w in zip(texts, byte.encode_batch(texts, add_special_tokens=False), _w.encode_all(pa.array(texts)), strict=True):
        assert _r.encode(x).tolist() == by.ids
        assert w.tolist() == word.encode(x, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_ids_of_given_texts_are_those_of_the_library():
    """All texts of 10,000 documents by the words' tokenizer and by the bytes' one."""
    texts = [x or "" for x in pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    rank, piece = RankEncoder(str(P.path("byte_bpe_50k.json"))), PieceEncoder(str(P.path("word_bpe_49k.json")))
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for x, by, w, own in zip(some, byte.encode_batch_fast(some, add_special_tokens=False), word.encode_batch_fast(some, add_special_tokens=False), piece.encode_all(pa.array(some)), strict=True):
            assert own.tolist() == w.ids and rank.encode(x).tolist() == by.ids


def test_special_strings_are_the_librarys_tokens():
    rank, piece = RankEncoder(str(P.path("byte_bpe_50k.json"))), PieceEncoder(str(P.path("word_bpe_49k.json")))
    assert rank.encode("x<|endoftext|>y").tolist() == [87, 50256, 88]
    assert 49407 in piece.encode_all(pa.array(["x<|endoftext|>y <|startoftext|>"]))[0].tolist()


def rows(spark):
    texts = [*SOME, None, "word " * 5000, "word " * 700, "same", "same"]
    return spark.createDataFrame([(i % 18, t, "clash") for i, t in enumerate(texts)], DOCS), texts


def test_packing(spark):
    docs, texts = rows(spark)
    found = packing.pack_documents(docs, str(P.path("byte_bpe_50k.json")), 256, 0, keep_ids=True).toPandas()
    want = sum(len(library("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert found.length.sum() == want and found.length.max() <= 256
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(bytes(r.ids)) == 4 * r.length for r in found.itertuples())
    ordered = found.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    sums = ordered.groupby("sequence_id").length.sum()
    assert sums.max() <= 256 and len(sums) <= -(-want // 256) + 1
    assert packing.pack_documents(docs.limit(0), str(P.path("byte_bpe_50k.json"))).count() == 0


def test_copies_of_one_document_are_dealt_to_many_tasks(spark, tmp_path):
    hot = [(None, "")] * 400 + [(7, "same words")] * 400 + [(i, f"word {i}") for i in range(400)]
    docs = spark.createDataFrame(hot, "doc_id long, text string").repartition(6)
    pieces = packing.token_pieces(docs, str(P.path("byte_bpe_50k.json")), 256, 0, False)
    most = packing.dealt(pieces, 64).groupBy("length", "chunk").count().agg({"count": "max"}).first()[0]
    assert most < 60
    found = packing.pack_documents(docs, str(P.path("byte_bpe_50k.json")), 256, 0).toPandas().sort_values(["sequence_id", "offset"])
    assert len(found) == 1200 and (found.offset == found.groupby("sequence_id").length.cumsum() - found.length).all()
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, str(P.path("word_bpe_49k.json")), 2)
    rows = spark.read.parquet(f"{path}/shards")
    assert rows.groupBy("shard").count().agg({"count": "max"}).first()[0] < 600
    read = token_files.read_token_files(spark, path).toPandas().sort_values("start")
    assert (read.start == read.n_tokens.cumsum() - read.n_tokens).all() and read.doc_id.isna().sum() == 400
    assert read.doc_id.fillna(-1).is_monotonic_increasing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plans_hold_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    runs = packing.plan_sequences(counts, 64)
    held = np.zeros(65, int)
    for n, items in runs:
        assert sum(length * many for length, many in items) <= 64
        for length, many in items:
            held[length] += n * many
    assert (held == counts).all()
    assert sum(length * 3 > 64 for n, items in runs for length, many in items for _ in range(many) if n) <= 2 * sum(n for n, _ in runs) + counts.sum()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=30))
def test_codes_round_trip(codes):
    codes = np.array(codes, np.uint32)
    control, data = token_files.encode(codes)
    assert (token_files.decode(control, data, len(codes)) == codes).all() and len(control) == -(-len(codes) // 4)


def test_token_files(spark):
    docs, texts = rows(spark)
    found = token_files.token_round_trip(docs, str(P.path("word_bpe_49k.json")), 2).toPandas()
    assert sorted(found.doc_id) == sorted(i % 18 for i in range(len(texts)))
    ordered = found.sort_values("start")
    assert ordered.doc_id.is_monotonic_increasing and (ordered.start == ordered.n_tokens.cumsum() - ordered.n_tokens).all()
    word = library("word_bpe_49k.json")
    crcs = [zlib.crc32(np.array(word.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for t in texts]
    assert sorted(found.ids_crc32) == sorted(crcs)
    assert token_files.token_round_trip(docs.limit(0), str(P.path("word_bpe_49k.json")), 2).count() == 0


def test_the_cache_is_bounded_and_changes_nothing(monkeypatch):
    texts = [f"common w{i} word{i % 7}, other!{i}" for i in range(400)]
    want = [x.ids for x in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    encoder = PieceEncoder(str(P.path("word_bpe_49k.json")))
    found = [x.tolist() for at in range(0, 400, 10) for x in encoder.encode_all(pa.array(texts[at : at + 10]))]
    assert found == want and len(encoder.numbers) <= 50 + 40 and "common" in encoder.numbers
