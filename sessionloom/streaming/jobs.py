"""The polling loop's work as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.config import refresh_interval
from sessionloom.functions import text as T
from sessionloom.operators.history import to_lines
from sessionloom.operators.traces import fold_traces
from sessionloom.operators.trends import runtime_trends


def streaming_bursts(events: DataFrame, keys: list[str], gap: str, lateness: str, least: float = 0) -> DataFrame:
    """Bursts of events (keys, ts) that the watermark has closed: first and last event, number of events.

    Lines later than ``lateness`` are dropped here; ``bursts.keep_bursts`` takes those of any lateness.
    With ``least`` bursts are stretched to that many seconds.
    """
    sessions = events.withWatermark("ts", lateness).groupBy(*keys, F.session_window("ts", f"{gap} 1 microsecond"))  # a gap of just that length does not part them
    out = sessions.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("events"))
    end = F.greatest("end_ts", F.timestamp_micros(F.unix_micros("start_ts") + F.lit(int(least * 1_000_000))))
    return out.drop("session_window").withColumn("end_ts", end)


def slot_requests(requests: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Refresh requests (ts), one for each slot."""
    return requests.withWatermark("ts", lateness).withColumn("slot", T.refresh_slot(F.col("ts"), seconds)).dropDuplicatesWithinWatermark(["slot"])


def sample_buckets(samples: DataFrame, step: str, lateness: str) -> DataFrame:
    """The last sample of each tumbling bucket."""
    metrics = F.struct("ts", *[c for c in samples.columns if c != "ts"])
    out = samples.withWatermark("ts", lateness).groupBy(F.window("ts", step)).agg(F.max(metrics).alias("m"))
    return out.select(F.col("window.start").alias("bucket"), "m.*")


def range_buckets(samples: DataFrame, now_us: int) -> DataFrame:
    """The last sample (at_us, metrics) of each bucket of each trend range, buckets counted from the range's own start, the one at ``now_us`` included.

    The state is a row a bucket, so it is bounded by the ranges whatever comes; output mode is update or complete.
    """
    return runtime_trends(samples, now_us)


def tick(every_s: int | None) -> dict:
    """The trigger of a job: all there is and then an end, or a batch every so many seconds (30 at least; 0 means paused, so once)."""
    seconds = refresh_interval(every_s or 0)
    return {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}


def keep_traces(lines: DataFrame, bronze: str, traces: str, checkpoint: str, every_s: int | None = None, buckets: int = 256):
    """Land new lines and fold the traces of the transcripts they touch again; a batch that is repeated gives the same.

    ``lines`` has path, tool, line_no and value, and a line keeps its number when
    its file is read again. Lines are landed by buckets of paths, so a batch
    reads the history of its own buckets alone. Traces are written by batch; the newest batch of a path holds.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{bronze}/batch={number}")
        landed = spark.read.parquet(f"{bronze}/batch={number}")
        some = [r.bucket for r in landed.select("bucket").distinct().collect()]  # ``buckets`` at most
        # only the folders of the touched buckets are read again
        every = spark.read.parquet(bronze).where((F.col("batch") <= number) & F.col("bucket").isin(some)).join(landed.select("path").distinct(), "path", "left_semi")
        newest = every.groupBy("path", "line_no").agg(F.max_by(F.struct("tool", "value"), "batch").alias("l"))
        fold_traces(newest.select("path", "line_no", "l.*")).write.mode("overwrite").parquet(f"{traces}/batch={number}")

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(tick(every_s))).start()


def latest_traces(spark, traces: str) -> DataFrame:
    """For each path the trace of its newest batch."""
    rows = spark.read.parquet(traces)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"]).drop("batch")


def keep_history(snapshots: DataFrame, path: str, checkpoint: str, every_s: int | None = None):
    """Append snapshot samples to the history, a folder for each batch and day; a batch that is repeated replaces its own. Retention holds on reading."""

    def land(batch: DataFrame, number: int) -> None:
        to_lines(batch).write.mode("overwrite").partitionBy("day").text(f"{path}/batch={number}")

    return snapshots.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**tick(every_s)).start()
