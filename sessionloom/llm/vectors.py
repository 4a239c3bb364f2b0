"""Vector columns for the embedding operators: which take part, and blocks of them for tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a task holds in one block.
BLOCK = 1024


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) whose vectors are not null or zero and hold no null or non-finite component."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(whole & some, F.lit(False)))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """Equal vectors as one row: embedding, its smallest ids (so many at most) and how many rows it has.

    Counts and ids are merged on the map side, so a vector that a third of the
    rows share is no hot key.
    """
    plain = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))  # -0.0 is 0.0
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = plain.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ids)
    first = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return first.join(plain.groupBy("embedding").agg(F.count("*").alias("copies")), "embedding")


def sample(rows: DataFrame, n: int, bound: int, seed: int) -> np.ndarray:
    """At most ``bound`` of the ``n`` rows' vectors, by hash order, as doubles."""
    drawn = rows.select(F.pmod(F.xxhash64(F.lit(seed), "embedding"), F.lit(1 << 30)).alias("drawn"), "embedding")
    below = min(1 << 30, int((bound + 4 * bound**0.5 + 16) / max(1, n) * (1 << 30)))
    found = drawn.where(F.col("drawn") < below).toArrow()  # about ``bound`` rows
    if not found.num_rows:
        return np.zeros((0, 0))
    found = found.combine_chunks()
    points, order = matrix(found.column(1).combine_chunks()), found.column(0).to_numpy()
    return points[np.lexsort((*points.T[:4], order))][:bound]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def in_blocks(rows: DataFrame, keys: list[str], columns: list[str], spread: str, block: int = BLOCK) -> DataFrame:
    """Gather rows of equal ``keys`` into lists of about ``block`` rows.

    Groups are split by a hash of ``spread`` into as many parts as their counted size asks for.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows_of_key"))
    parts = F.ceil(F.col("rows_of_key") / block).cast("int")
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(spread), parts).cast("int"))
    return dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct(*columns)).alias("items"))
