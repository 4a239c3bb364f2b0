"""Best-fit packing of tokenized documents into fixed-length sequences (operator 8).

Large-item matching: pieces above a third of the capacity are matched greedily,
at most two to a sequence; smaller pieces then fill the tightest gap that holds
them. Lengths are integers up to the capacity, so the plan is made on the
histogram of lengths, whose size does not depend on the data, in runs of
sequences that are filled alike. Each piece then finds its place from its
length and its rank among pieces of that length; the ranks come from counts per
(chunk, length), so no length is ever gathered in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import bound_batches, id_and_text, materialize
from sessionloom.llm.tokens import rank_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids; the first one is the short one."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Tokenize every whole text and cut what is longer than ``capacity``."""

    def pieces(batches):
        encoder = rank_encoder(path)
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(data), data), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns if keep_ids else columns[:5], names if keep_ids else names[:5])

    bound_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(pieces, PIECES + (", ids binary" if keep_ids else ""))


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs ``(sequences, [(length, how many in each)])`` that hold ``counts[length]`` pieces of each length."""
    left = np.asarray(counts).astype(np.int64).copy()
    runs: list[list] = []  # [sequences, gap, items]
    third = capacity // 3  # lengths above it are large
    # large pieces, largest first, each with the largest large piece that fits beside it
    for i in range(capacity, third, -1):
        while left[i]:
            j = min(i, capacity - i)
            while j > third and (left[j] == 0 or (j == i and left[i] < 2)):
                j -= 1
            if j <= third:
                runs.append([int(left[i]), capacity - i, [(i, 1)]])
                left[i] = 0
            elif j == i:
                runs.append([int(left[i]) // 2, capacity - 2 * i, [(i, 2)]])
                left[i] %= 2
            else:
                n = int(min(left[i], left[j]))
                runs.append([n, capacity - i - j, [(i, 1), (j, 1)]])
                left[i] -= n
                left[j] -= n
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    for r, run in enumerate(runs):
        by_gap[run[1]].append(r)
    # small pieces, largest first, into the smallest gap that holds them
    for s in range(third, 0, -1):
        n = int(left[s])
        gap = s
        while n:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // s
                full, rest = divmod(n, each)
                for bins, many in ((full, each), (min(rest, 1), rest)):
                    if bins:
                        runs.append([bins, capacity - many * s, [(s, many)]])
                        by_gap[runs[-1][1]].append(len(runs) - 1)
                break
            at = by_gap[gap].pop()
            run = runs[at]
            each = gap // s
            full = min(run[0], n // each)
            for bins, many in ((full, each), (1 if full < run[0] and n - full * each else 0, n - full * each)):
                if bins:
                    many = min(many, each)
                    runs.append([bins, gap - many * s, run[2] + [(s, many)]])
                    by_gap[runs[-1][1]].append(len(runs) - 1)
                    run[0] -= bins
                    n -= bins * many
            if run[0]:
                by_gap[gap].append(at)
    return [(n, items) for n, _, items in runs if n]


def slots(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each, offset), by length and rank."""
    rows, taken, base = [], {}, 0
    for n, items in runs:
        offset = 0
        for length, many in items:
            rows.append((length, taken.get(length, 0), base, many, offset))
            taken[length] = taken.get(length, 0) + n * many
            offset += length * many
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def dealt(pieces: DataFrame, chunks: int) -> DataFrame:
    """Add nth_row, a number of each row, and its chunk; rows alike in all else differ by their number, so that no chunk holds all copies of a document."""
    numbered = pieces.withColumn("nth_row", F.monotonically_increasing_id())
    return numbered.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth_row"), F.lit(chunks)).cast("int"))


def pack(pieces: DataFrame, capacity: int, chunks: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces ``(doc_id, piece, start, length, ids_crc32, ...)``."""
    kept = materialize(dealt(pieces, chunks), "pieces")
    by_chunk = kept.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_chunk.groupBy("length").agg(F.sum("n")).collect():  # at most one row a length
        counts[length] = n
    table = slots(plan_sequences(counts, capacity))
    before = by_chunk.select(
        "length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "nth_row")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).join(before, ["length", "chunk"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") - 1 + F.col("before")).alias("rank"))
    step, names = 1 << 40, pieces.columns

    def place(batches):
        keys = table[:, 0] * step + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length * step + rank, side="right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as the method finds.

    A document is its ids by the tokenizers file at ``path`` and then
    ``end_id``. Only longer ones are cut, into pieces of ``capacity`` ids of
    which the first may be shorter. Returns doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and with ``keep_ids`` the ids as bytes.

    Null and empty texts are one ``end_id``; texts of any length are tokenized whole.
    Pieces of one length are dealt by a hash into chunks and ranked there by doc_id, piece and content; rows alike in all
    of these are interchangeable and go to chunks of their own. Repeated rows are separate documents. An empty table gives no rows; further columns are ignored. A null
    doc_id is kept as null.
    """
    return pack(token_pieces(docs, path, capacity, end_id, keep_ids), capacity)
