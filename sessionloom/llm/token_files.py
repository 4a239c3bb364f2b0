"""Token ids in compact binary files (operator 10).

Ids are replaced by their rank of frequency over all documents and written in a
byte-aligned variable-length code: one to four data bytes an id, with the byte
counts of four ids in each byte of a separate control stream. Decoding looks the
four counts of a control byte up in a table, for all bytes at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_tables, id_and_text, materialize, new_path
from sessionloom.llm.tokens import piece_encoder, runs

#: Byte counts of the four codes that a control byte describes.
COUNTS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit codes."""
    codes = np.asarray(codes, np.uint32)
    most = int(codes.max()) if len(codes) else 0
    extra = (codes > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if most > limit:
            extra += codes > limit
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = extra
    control = padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    width = 2 if most <= 0xFFFF else 4
    used = np.empty((len(codes), width), bool)
    for k in range(width):
        used[:, k] = extra >= k
    return control.tobytes(), codes.astype(f"<u{width}").view(np.uint8)[used.ravel()].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` codes that ``encode`` wrote."""
    counts = COUNTS[np.frombuffer(control, np.uint8)].ravel()[:n]
    width = 2 if n and counts.max() <= 2 else 4
    used = np.empty((n, width), bool)
    for k in range(width):
        used[:, k] = counts > k
    out = np.zeros(n * width, np.uint8)
    out[used.ravel()] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{width}").astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text and write the ids in ascending doc_id order.

    ``path`` gets three tables: ``ranks`` (id, rank), one row for each id in
    use and so bounded by the vocabulary; ``shards``, whose part files follow
    each other in ascending doc_id order and have a record for each document
    (shard, doc_id, local_start, n_tokens, control, data); and ``totals``, the
    number of ids in each shard. Null texts count as empty; texts of any length
    are encoded whole; repeated rows stay separate documents; rows of one doc_id
    are in the order of a hash of their ids, and however many, are written by many tasks; ids used alike often rank by id; null
    doc_ids come first; an empty table gives empty files; further columns are ignored.
    """
    spark = docs.sparkSession

    def tokens(batches):
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            for texts, at in runs(batch.column(1)):
                ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode_all(texts)]
                small = "<u2" if max((int(x.max()) for x in ids), default=0) < 1 << 16 else "<u4"
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), pa.array([x.astype(small).tobytes() for x in ids], pa.binary()), pa.array([int(small[2])] * len(ids), pa.int32())],
                    ["doc_id", "ids", "width"],
                )

    encoded = id_and_text(docs).mapInArrow(tokens, "doc_id long, ids binary, width int")
    # rows alike in doc_id and ids differ by their number, so that a range can end between them
    held = materialize(encoded.withColumns({"ids_key": F.xxhash64("ids"), "nth_row": F.monotonically_increasing_id()}), "ids")

    def counts(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for width in {w for _, w in rows}:
                found = np.bincount(np.frombuffer(b"".join(ids for ids, w in rows if w == width), f"<u{width}"))
                total = np.pad(total, (0, max(0, len(found) - len(total))))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    summed = held.select("ids", "width").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_use = sorted(summed.collect(), key=lambda r: (-r.n, r.id))  # at most one row for each id of the vocabulary
    ranked = np.array([r.id for r in by_use], np.int64)
    spark.createDataFrame([(int(i), k) for k, i in enumerate(ranked)], "id long, rank long").write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))

    def records(batches):
        shard, start = None, 0
        for batch in batches:
            rows = ([], [], [], [])
            shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
            for ids, width in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True):
                code = rank_of[np.frombuffer(ids.as_buffer(), f"<u{width}")]
                for column, value in zip(rows, (start, len(code), *encode(code)), strict=True):
                    column.append(value)
                start += len(code)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [batch.column("shard"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "local_start", "n_tokens", "control", "data"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "ids_key", "nth_row"]
    ordered = held.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "ids", "width")
    kinds = "shard int, doc_id long, local_start long, n_tokens long, control binary, data binary"
    ordered.mapInArrow(records, kinds).write.parquet(f"{path}/shards")
    drop_tables(spark, held)
    written = spark.read.schema(kinds).parquet(f"{path}/shards")
    written.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{path}/totals")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, and with ``keep_ids`` the ids as bytes."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # bounded by the vocabulary
    id_of = np.array([r.id for r in ranks] or [0], np.uint32)

    def ids(batches):
        for batch in batches:
            crc, held = [], []
            for n, control, data in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "control", "data")), strict=True):
                found = id_of[decode(control, data, n)].astype("<u4").tobytes()
                crc.append(zlib.crc32(found))
                if keep_ids:
                    held.append(found)
            names = ["shard", "doc_id", "local_start", "n_tokens"]
            columns = [*(batch.column(c) for c in names), pa.array(crc, pa.int64())] + ([pa.array(held, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids_crc32"] + ["ids"] * keep_ids)

    kinds = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    totals = spark.read.schema("shard int, n_tokens long").parquet(f"{path}/totals")  # one row a shard
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    bases = totals.select("shard", before.alias("base"))
    read = spark.read.parquet(f"{path}/shards").mapInArrow(ids, kinds)
    return read.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids
    )


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents to files and return what is read back from them, a row for each."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
