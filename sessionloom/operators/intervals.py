"""Sessionization by idle gap and interval concurrency."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(seconds: float) -> int:
    return int(seconds * 1_000_000)


def normalize(spans: DataFrame, min_interval_s: float) -> DataFrame:
    """Fill a missing end or start from the other, put a reversed end at the start, stretch to the least length.

    ``start_us`` and ``end_us`` are microseconds; rows with neither are dropped.
    """
    start = F.coalesce("start_us", "end_us")
    end = F.greatest(F.coalesce("end_us", "start_us"), start)
    least = micros(min_interval_s)
    out = spans.withColumns({"start_us": start, "end_us": end}).where("start_us is not null")
    return out.withColumn("end_us", F.when(F.col("end_us") - F.col("start_us") < least, F.col("start_us") + least).otherwise(F.col("end_us")))


def session_spans(events: DataFrame, keys: list[str], min_interval_s: float) -> DataFrame:
    """One span from first to last event of each key."""
    spans = events.groupBy(*keys).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return normalize(spans, min_interval_s)


def burst_spans(events: DataFrame, keys: list[str], idle_gap_s: float, min_interval_s: float) -> DataFrame:
    """Runs of events with no gap longer than ``idle_gap_s``; a gap of just that length does not part them.

    Runs are found within each day of a key, then those of a key are joined over
    the days' borders, so a long key is sorted by days, and only its runs as a whole.
    """
    gap = micros(idle_gap_s)

    def runs(spans: DataFrame, within: list[str]) -> DataFrame:
        order = Window.partitionBy(*within).orderBy("start_us", "end_us")
        opens = F.coalesce((F.col("start_us") - F.lag("end_us").over(order) > gap).cast("int"), F.lit(1))
        marked = spans.withColumn("opens", opens).withColumn("burst", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*within, "burst").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events"))

    points = events.select(*keys, F.floor(F.col("ts_us") / 86_400_000_000).alias("day"), F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.lit(1).cast("long").alias("events"))
    return normalize(runs(runs(points, [*keys, "day"]), keys), min_interval_s)


def clipped(spans: DataFrame, from_us: int, to_us: int) -> DataFrame:
    inside = spans.where((F.col("end_us") > from_us) & (F.col("start_us") < to_us))
    return inside.withColumns({"start_us": F.greatest("start_us", F.lit(from_us)), "end_us": F.least("end_us", F.lit(to_us))}).where("end_us > start_us")


def peak_concurrency(spans: DataFrame, from_us: int, to_us: int, keys: list[str] = ()) -> DataFrame:
    """Largest number of spans open at once and its earliest time, by key; spans are open at their start, not at their end.

    A two-level sweep: net changes per hour, running inside each hour, on top of
    the sum of the hours before; so only the table of hours is one partition.
    """
    keys = list(keys)
    inside = clipped(spans, from_us, to_us)
    change = lambda at, by: inside.select(*keys, F.col(at).alias("at_us"), F.lit(by).alias("by"))
    changes = change("start_us", 1).unionAll(change("end_us", -1)).groupBy(*keys, "at_us").agg(F.sum("by").alias("by"))
    changes = changes.withColumn("hour", F.floor(F.col("at_us") / 3_600_000_000))
    nets = changes.groupBy(*keys, "hour").agg(F.sum("by").alias("net"))
    hours = Window.partitionBy(*keys).orderBy("hour") if keys else Window.partitionBy(F.lit(0)).orderBy("hour")
    before = nets.select(*keys, "hour", (F.sum("net").over(hours) - F.col("net")).alias("before"))
    running = Window.partitionBy(*keys, "hour").orderBy("at_us")
    levels = changes.withColumn("inside", F.sum("by").over(running)).join(before, [*keys, "hour"])
    levels = levels.select(*keys, "at_us", (F.col("inside") + F.col("before")).alias("level"))
    best = levels.groupBy(*keys).agg(F.max(F.struct("level", (-F.col("at_us")).alias("minus"))).alias("top"))
    return best.select(*keys, F.coalesce("top.level", F.lit(0)).alias("peak"), (-F.col("top.minus")).alias("peak_at_us"))


def grid(spark, from_us: int, to_us: int, step_us: int) -> DataFrame:
    """(i, at_us) from ``from_us`` by steps, with ``to_us`` at the end if no step meets it."""
    points = spark.range(1).select(F.explode(F.sequence(F.lit(from_us), F.lit(to_us), F.lit(step_us))).alias("at_us"))
    points = points.union(spark.range(1).select(F.lit(to_us).alias("at_us"))).distinct()
    return points.withColumn("i", F.ceil((F.col("at_us") - from_us) / step_us))


def concurrency_series(spans: DataFrame, from_us: int, to_us: int, step_us: int) -> DataFrame:
    """(at_us, level): open spans at the points of a grid.

    Spans are clipped to the grid, so that at its last point none is open.
    Changes are counted per grid place and summed along the grid: no span is compared with a point.
    """
    place = lambda c: F.ceil((F.col(c) - from_us) / step_us).alias("i")
    inside = clipped(spans, from_us, to_us)
    changes = inside.select(place("start_us"), F.lit(1).alias("by")).unionAll(inside.select(place("end_us"), F.lit(-1).alias("by")))
    changes = changes.groupBy("i").agg(F.sum("by").alias("by"))
    level = F.sum(F.coalesce("by", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("i"))
    return grid(spans.sparkSession, from_us, to_us, step_us).join(changes, "i", "left").select("at_us", level.alias("level"))


def concurrency_at(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(at_us, level) for any points: starts up to each less ends up to it, by a sweep over both."""
    events = (
        points.select(F.col("at_us"), F.lit(0).alias("by"), F.lit(True).alias("asked")).distinct()
        .unionAll(spans.select(F.col("start_us").alias("at_us"), F.lit(1).alias("by"), F.lit(False).alias("asked")))
        .unionAll(spans.select(F.col("end_us").alias("at_us"), F.lit(-1).alias("by"), F.lit(False).alias("asked")))
    )
    at = events.groupBy("at_us").agg(F.sum("by").alias("by"), F.max("asked").alias("asked"))
    at = at.withColumn("hour", F.floor(F.col("at_us") / 3_600_000_000))
    nets = at.groupBy("hour").agg(F.sum("by").alias("net"))
    before = nets.select("hour", (F.sum("net").over(Window.partitionBy(F.lit(0)).orderBy("hour")) - F.col("net")).alias("before"))
    level = F.sum("by").over(Window.partitionBy("hour").orderBy("at_us"))
    return at.withColumn("inside", level).join(before, "hour").where("asked").select("at_us", (F.col("inside") + F.col("before")).alias("level"))


def day_start(now_us: int, zone: str) -> int:
    """Midnight before ``now_us`` by the clocks of a time zone."""
    now = datetime.fromtimestamp(now_us / 1_000_000, ZoneInfo(zone))
    return int(now.replace(hour=0, minute=0, second=0, microsecond=0).timestamp()) * 1_000_000


def us(column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))
