"""Places in a global order without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.landing import land


def with_place(rows: DataFrame, *order: Column | str, place: str = "place", land=land) -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``order``.

    Two passes: the rows are dealt by ranges of the order, sorted and numbered within each
    range, and written by ``land(frame, name)``; the ranges' sizes, a row each, then
    give every range its offset. ``order`` has to be total where places are to
    be the same on every run: rows equal in it may change places, and share a range. An empty table gives no rows.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number within a partition: what monotonically_increasing_id() holds in its low 33 bits
    numbered = ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = land(numbered, place)
    sizes = numbered.groupBy("_range").agg((F.max("_at") + 1).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))  # a row a range, as many as spark.sql.shuffle.partitions
    return numbered.join(F.broadcast(offsets), "_range").withColumn(place, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")
