"""Snapshot history: reading samples back, retention, allocation, growth and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.config import HISTORY_RETENTION_DAYS
from sessionloom.functions import text as T

SCHEMA = (
    "at string, current struct<pid_concurrency:bigint,session_concurrency:bigint,active_burst_concurrency:bigint>,"
    "summary struct<mapped_processes:bigint,unmapped_processes:bigint>,"
    "projects array<struct<project:string,session_count:bigint,active_burst_count:bigint,process_count:bigint,attention_share_pct:double>>, broken string"
)
RETENTION_US = HISTORY_RETENTION_DAYS * 86_400_000_000
METRICS = ("pid_concurrency", "session_concurrency", "active_burst_concurrency", "mapped_processes", "unmapped_processes")


def parse(lines: DataFrame) -> DataFrame:
    """Samples of non-blank lines (line_no, value) with at_us; ``ok`` is false where JSON or time is broken."""
    parsed = lines.where(T.stripped("value") != "").withColumn("s", F.from_json(T.stripped("value"), SCHEMA, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}))
    out = parsed.withColumn("at_us", F.unix_micros(T.observed_time("s.at")))
    whole = F.col("s").isNotNull() & F.col("s.broken").isNull() & F.col("at_us").isNotNull() & T.stripped("value").rlike("\\}$")
    return out.withColumn("ok", whole)


def load_statistics(parsed: DataFrame, now_us: int) -> DataFrame:
    """One row: loaded, dropped, corrupt and retained samples, first and last retained time."""
    old = F.col("at_us") < now_us - RETENTION_US
    kept = F.when(F.col("ok") & ~old, F.col("s.at"))
    kept_us = F.when(F.col("ok") & ~old, F.col("at_us"))
    return parsed.agg(
        F.count_if("ok").alias("loaded"), F.count_if(F.col("ok") & old).alias("dropped"), F.count_if(~F.col("ok")).alias("corrupt"),
        F.count_distinct(kept).alias("retained"), F.min(kept_us).alias("first_us"), F.max(kept_us).alias("last_us"),
    )


def retained(parsed: DataFrame, now_us: int) -> DataFrame:
    """Samples of the last 30 days, the last line of each time text."""
    recent = parsed.where(F.col("ok") & (F.col("at_us") >= now_us - RETENTION_US))
    return recent.groupBy("s.at").agg(F.max_by(F.struct("at_us", "s"), "line_no").alias("m")).select(
        "at", "m.at_us", *[F.coalesce(f"m.s.current.{c}", F.lit(0)).alias(c) for c in METRICS[:3]], *[F.coalesce(f"m.s.summary.{c}", F.lit(0)).alias(c) for c in METRICS[3:]], "m.s.projects"
    )


def in_range(samples: DataFrame, from_us: int | None, to_us: int | None) -> DataFrame:
    """Samples between both times, ends included; a missing end is open, an inverted range is empty."""
    if from_us is not None and to_us is not None and to_us < from_us:
        return samples.limit(0)
    low = F.lit(True) if from_us is None else F.col("at_us") >= from_us
    return samples.where(low & (F.lit(True) if to_us is None else F.col("at_us") <= to_us))


def allocation(samples: DataFrame) -> DataFrame:
    """Per project: samples, average and peak share of attention, largest counts; most attention first."""
    rows = samples.select(F.explode("projects").alias("p")).select(T.stripped("p.project").alias("project"), "p.session_count", "p.active_burst_count", "p.process_count", "p.attention_share_pct")
    out = rows.where("project <> ''").groupBy("project").agg(
        F.count("*").alias("samples"), (F.sum("attention_share_pct") / F.count("*")).alias("average_share_pct"), F.max("attention_share_pct").alias("peak_share_pct"),
        F.max("session_count").alias("max_sessions"), F.max("active_burst_count").alias("max_active_bursts"), F.max("process_count").alias("max_processes"),
    )
    return out.orderBy(F.desc("average_share_pct"), F.desc("peak_share_pct"), "project")


def growth(samples: DataFrame) -> DataFrame:
    """One row: first and last values of the concurrency metrics and their differences."""
    ends = samples.agg(F.count("*").alias("samples"), F.min("at_us").alias("from_us"), F.max("at_us").alias("to_us"), *[f(c, "at_us").alias(f"{c}_{n}") for c in METRICS[:3] for f, n in ((F.min_by, "start"), (F.max_by, "end"))])
    return ends.select("*", *[(F.col(f"{c}_end") - F.col(f"{c}_start")).alias(f"{c}_delta") for c in METRICS[:3]])


def peaks(samples: DataFrame) -> DataFrame:
    """(metric, value, at_us): the largest value of each metric and its earliest time."""
    long = samples.select("at_us", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in METRICS])).alias("m")).select("at_us", "m.*")
    best = long.groupBy("metric").agg(F.max(F.struct("value", (-F.col("at_us")).alias("minus"))).alias("b"))
    return best.select("metric", "b.value", (-F.col("b.minus")).alias("at_us"))


def to_lines(snapshots: DataFrame) -> DataFrame:
    """Samples as JSON text lines, with the time as RFC 3339 and the day they belong to."""
    stamp = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.struct(stamp.alias("at"), F.struct(*METRICS[:3]).alias("current"), F.struct(*METRICS[3:]).alias("summary"), "projects")
    return snapshots.select(F.to_date(F.timestamp_micros("at_us")).alias("day"), F.to_json(body).alias("value"))


def append(snapshots: DataFrame, path: str) -> None:
    """Append samples to the history at ``path``, in one folder a day, so that reading prunes by retention."""
    to_lines(snapshots).write.mode("append").partitionBy("day").text(path)
