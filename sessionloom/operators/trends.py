"""Trend windows: concurrency over fixed ranges, runtime samples in buckets, smoothing and resampling.

A metric that wasn't sampled is null; a sampled zero is 0.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.config import TREND_SPECS
from sessionloom.operators.intervals import grid, micros


def evidence_start(events: DataFrame, spans: DataFrame, from_us: int, now_us: int) -> DataFrame:
    """One row (start_us): the earliest event, or start of an overlapping span put no earlier than ``from_us``."""
    from_us = min(from_us, now_us)
    at = events.where(F.col("ts_us").between(from_us, now_us)).select("ts_us")
    over = spans.where((F.col("end_us") >= from_us) & (F.col("start_us") <= now_us)).select(F.greatest("start_us", F.lit(from_us)).alias("ts_us"))
    return at.union(over).agg(F.min("ts_us").alias("start_us"))


def transcript_trends(sessions: DataFrame, bursts: DataFrame, start: DataFrame, now_us: int, specs=TREND_SPECS) -> DataFrame:
    """(range, at_us, sessions, bursts) at every grid point of every range; null before the evidence starts."""
    spark = sessions.sparkSession
    ranges = spark.createDataFrame([(label, now_us - micros(span), micros(step)) for label, span, step in specs], "range string, from_us long, step_us long")
    both = sessions.select(F.lit("sessions").alias("kind"), "start_us", "end_us").unionAll(bursts.select(F.lit("bursts"), "start_us", "end_us"))
    # every span once, with the ranges it touches: changes by (kind, range, grid place) are summed on the map side
    inside = both.crossJoin(F.broadcast(ranges)).withColumns({"a": F.greatest("start_us", "from_us"), "b": F.least("end_us", F.lit(now_us))}).where("b > a and end_us > from_us")  # five rows
    place = lambda c: F.ceil((F.col(c) - F.col("from_us")) / F.col("step_us"))
    change = lambda c, by: F.struct(place(c).alias("i"), F.lit(by).alias("by"))
    changes = inside.select("kind", "range", F.explode(F.array(change("a", 1), change("b", -1))).alias("c")).groupBy("kind", "range", "c.i").agg(F.sum("c.by").alias("by"))
    spans = [(label, now_us - micros(span), micros(step)) for label, span, step in specs]
    points = [(label, -(-(at - first) // step), at) for label, first, step in spans for at in sorted({*range(first, now_us + 1, step), now_us})]
    points = spark.createDataFrame(points, "range string, i long, at_us long")
    kinds = points.crossJoin(spark.createDataFrame([("sessions",), ("bursts",)], "kind string"))  # two rows
    level = F.sum(F.coalesce("by", F.lit(0))).over(Window.partitionBy("kind", "range").orderBy("i"))
    levels = kinds.join(changes, ["kind", "range", "i"], "left").withColumn("level", level)
    of_kind = lambda k: F.max(F.when(F.col("kind") == k, F.col("level"))).alias(k)
    points = levels.groupBy("range", "at_us").agg(of_kind("sessions"), of_kind("bursts")).crossJoin(F.broadcast(start))  # start has one row
    known = F.col("start_us").isNotNull() & (F.col("at_us") >= F.col("start_us"))
    return points.select("range", "at_us", *[F.when(known, F.col(c)).alias(c) for c in ("sessions", "bursts")])


def coverage(start: DataFrame, now_us: int, specs=TREND_SPECS) -> DataFrame:
    """Per range: whether the evidence reaches back to its start, and over how many whole hours there is any."""
    spark = start.sparkSession
    ranges = spark.createDataFrame([(label, now_us - micros(span), step) for label, span, step in specs], "range string, from_us long, step_s int")
    hours = F.floor((F.lit(now_us) - F.col("start_us")) / 3_600_000_000)
    return ranges.crossJoin(start).select("range", "from_us", "step_s", F.coalesce(F.col("start_us") <= F.col("from_us"), F.lit(False)).alias("complete"), hours.alias("lookback_hours"))


def runtime_trends(samples: DataFrame, now_us: int, specs=TREND_SPECS) -> DataFrame:
    """The last sample (at_us, metrics) of each bucket of each range, at its own time."""
    spark = samples.sparkSession
    ranges = spark.createDataFrame([(label, now_us - micros(span), micros(step)) for label, span, step in specs], "range string, from_us long, step_us long")
    inside = samples.crossJoin(F.broadcast(ranges)).where((F.col("at_us") >= F.col("from_us")) & (F.col("at_us") <= now_us))  # five rows
    bucket = F.floor((F.col("at_us") - F.col("from_us")) / F.col("step_us")).alias("bucket")
    metrics = F.struct("at_us", *[c for c in samples.columns if c != "at_us"])
    return inside.groupBy("range", bucket).agg(F.max(metrics).alias("m")).select("range", "bucket", "m.*")


def merge(history: DataFrame, runtime: DataFrame, columns: list[str]) -> DataFrame:
    """Points of both by time; runtime's values go before history's."""
    r = runtime.select("at_us", *[F.col(c).alias(f"r_{c}") for c in columns])
    return history.join(r, "at_us", "full").select("at_us", *[F.coalesce(f"r_{c}", c).alias(c) for c in columns])


def smooth(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Weights 1-2-3-2-1 over ninths; ends, and series of fewer than four points, stay. A missing neighbour's place is taken by the one inside it."""
    order = Window.partitionBy(*keys).orderBy("at_us")
    n, place = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(order)
    v, near = F.col(value), lambda f, k: f(value, k).over(order)
    before, after = F.coalesce(near(F.lag, 1), v), F.coalesce(near(F.lead, 1), v)
    two_before, two_after = F.coalesce(near(F.lag, 2), before), F.coalesce(near(F.lead, 2), after)
    soft = (two_before + before * 2 + v * 3 + after * 2 + two_after) / 9
    end = (place == 1) | (place == n)
    return points.withColumn("smoothed", F.when((n < 4) | end, v.cast("double")).otherwise(soft))


def resample(points: DataFrame, keys: list[str], value: str, count: int) -> DataFrame:
    """(keys, i, x, value) at ``count`` places evenly between first and last point, by linear interpolation.

    Each place is put among the points by time and takes the nearest ones on either side.
    """
    ends = points.groupBy(*keys).agg(F.min("at_us").alias("first"), F.max("at_us").alias("last"))
    places = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    x = F.col("first") + (F.col("last") - F.col("first")) * F.col("i") / (count - 1)
    places = places.select(*keys, "i", x.alias("x"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("px"))
    own = points.select(*keys, F.lit(None).cast("int").alias("i"), F.col("at_us").cast("double").alias("x"), F.col(value).cast("double").alias("v"), F.col("at_us").cast("double").alias("px"))
    both = places.unionByName(own)
    order = Window.partitionBy(*keys).orderBy("x", F.col("i").isNotNull())
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("x"), F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    side = lambda c, w: F.last(c, ignorenulls=True).over(w)
    both = both.withColumns({"lv": side("v", back), "lx": side("px", back), "rv": side("v", ahead), "rx": side("px", ahead)}).where("i is not null")
    ratio = F.when(F.col("rx") > F.col("lx"), (F.col("x") - F.col("lx")) / (F.col("rx") - F.col("lx"))).otherwise(0.0)
    return both.select(*keys, "i", "x", (F.col("lv") + (F.col("rv") - F.col("lv")) * ratio).alias("value"))


def latest(points: DataFrame, keys: list[str], sampled: str, chosen_us: int | None = None) -> DataFrame:
    """The sampled point of each series at the chosen time, or its latest one where there is none such."""
    place = F.struct((F.col("at_us") == chosen_us) if chosen_us is not None else F.lit(False), F.col("at_us"))
    found = points.where(F.col(sampled).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("at_us", sampled), place).alias("p"))
    return found.select(*keys, "p.at_us", f"p.{sampled}")


def history_points(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """History samples as trend points, at whole seconds; of the samples of a second the last one."""
    second = F.floor(F.col("at_us") / 1_000_000) * 1_000_000
    last = samples.groupBy(second.alias("second")).agg(F.max_by(F.struct(*metrics), "at_us").alias("m"))
    return last.select(F.col("second").alias("at_us"), "m.*")


def to_json_points(points: DataFrame) -> DataFrame:
    """Points as JSON text without the metrics that weren't sampled."""
    return points.select(F.to_json(F.struct(*points.columns)).alias("value"))


__all__ = ["coverage", "evidence_start", "grid", "history_points", "latest", "merge", "resample", "runtime_trends", "smooth", "to_json_points", "transcript_trends"]
