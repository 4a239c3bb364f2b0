"""Bursts kept up to date under lines that come in any order and at any delay.

The table holds bursts, not events. A batch reads the buckets of keys that its
events fall into, opens the bursts that an event touches, and leaves all others as they are; so a
line a day late costs the bursts around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.intervals import micros

DAY_US = 86_400_000_000
SPAN = ["start_us", "end_us", "events"]


def joined_runs(spans: DataFrame, within: list[str], gap: int) -> DataFrame:
    """Spans of a key that lie no more than ``gap`` apart as one."""
    order = Window.partitionBy(*within).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start_us") - reach > gap).cast("int"), F.lit(1))
    marked = spans.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*within, "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events")).drop("_run")


def repaired(bursts: DataFrame, late: DataFrame, keys: list[str], idle_gap_s: float) -> DataFrame:
    """``bursts`` (keys, start_us, end_us, events; unstretched) after further events ``late`` (keys, ts_us), as if they had been there from the start.

    Late events are first joined with each other, by days. Only bursts that such a
    run comes near to within the gap are opened; bursts lie further apart from each other than that, so no other one can change.
    """
    gap = micros(idle_gap_s)
    points = late.select(*keys, F.floor(F.col("ts_us") / DAY_US).alias("_day"), F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.lit(1).cast("long").alias("events"))
    runs = joined_runs(joined_runs(points, [*keys, "_day"], gap).drop("_day"), keys, gap)
    days = lambda low, high: F.explode(F.sequence(F.floor(low / DAY_US), F.floor(high / DAY_US)))
    near = runs.select(*keys, (F.col("start_us") - gap).alias("_low"), (F.col("end_us") + gap).alias("_high"))
    near = near.withColumn("_day", days(F.col("_low"), F.col("_high")))
    held = bursts.withColumn("_day", days(F.col("start_us"), F.col("end_us")))
    touched = held.join(near, [*keys, "_day"]).where("end_us >= _low and start_us <= _high").select(*keys, *SPAN).distinct()
    untouched = bursts.join(touched, [*keys, "start_us"], "left_anti").select(*keys, *SPAN)
    return untouched.unionByName(joined_runs(touched.unionByName(runs), keys, gap).select(*keys, *SPAN))


def keep_bursts(events: DataFrame, keys: list[str], idle_gap_s: float, lateness_s: float, root: str, checkpoint: str, every_s: int | None = None, buckets: int = 256):
    """Keep the table of bursts below ``root`` under a stream of events (keys, ts_us).

    Each batch writes the buckets it changed under its own number; a batch that is repeated replaces its own. Events
    more than ``lateness_s`` behind the latest one of earlier batches also go to the folder ``late``, for what
    has used the bursts before. ``current_bursts`` reads the table.
    """
    from sessionloom.streaming.jobs import tick

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select(*keys, "ts_us").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        own.write.mode("overwrite").parquet(f"{root}/in/batch={number}")
        own = spark.read.parquet(f"{root}/in/batch={number}")
        seen = own.agg(F.max("ts_us")).first()[0]
        if seen is None:
            return
        before = spark.read.schema("latest long, batch long").parquet(f"{root}/latest").where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        if before is not None:
            own.where(F.col("ts_us") < before - micros(lateness_s)).drop("bucket").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # ``buckets`` at most
        old = current_bursts(spark, root, keys, own.drop("ts_us").schema, number).where(F.col("bucket").isin(touched))
        new = repaired(old.drop("bucket"), own, keys, idle_gap_s).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/bursts/batch={number}")
        latest = seen if before is None else max(seen, before)
        spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{root}/latest/batch={number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**tick(every_s)).start()


def current_bursts(spark, root: str, keys: list[str], kinds, below: int | None = None) -> DataFrame:
    """(keys, start_us, end_us, events, bucket): each bucket as the newest batch, below a number, has written it."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields if f.name in keys], *[f"{c} long" for c in SPAN], "bucket int", "batch long"])
    if below == 0:
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.schema(schema).option("basePath", f"{root}/bursts").parquet(f"{root}/bursts")
    rows = rows if below is None else rows.where(F.col("batch") < below)
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # folder names alone
    return rows.join(F.broadcast(newest), ["bucket", "batch"]).select(*keys, *SPAN, "bucket")  # a row a bucket
