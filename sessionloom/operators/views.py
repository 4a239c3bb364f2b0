"""Views for reading: redaction, search, session trees, project orders and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators.ranking import with_place


def redacted_sessions(observed: DataFrame) -> DataFrame:
    """Sessions without path columns and with redacted texts and bucket keys."""
    project = T.redact_token(F.col("attributed"))
    return observed.select(
        "tool", T.redact_token(F.col("session_id")).alias("session_id"), project.alias("project"), "freshness", "confidence",
        F.transform("attribution_reasons", T.redact_text).alias("reasons"),
        F.format_string("project=%s|tool=%s|freshness=%s", project, "tool", "freshness").alias("key"),
    )


def search(observed: DataFrame, processes: DataFrame, query: str) -> DataFrame:
    """(kind, id) of projects, sessions and processes whose shown fields hold the text, in any case."""
    shown = lambda *cs: F.lower(F.concat_ws(" ", *cs))
    parts = [
        observed.select(F.lit("project").alias("kind"), F.col("attributed").alias("id"), shown("attributed").alias("text")).distinct(),
        observed.select(F.lit("session"), F.concat_ws("/", "tool", "session_id"), shown("tool", "session_id", "attributed", "freshness", "role")),
        processes.select(F.lit("process"), F.col("pid").cast("string"), shown("tool", F.col("pid").cast("string"), "command")),
    ]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return every.where(F.col("text").contains(query.lower().strip())).select("kind", "id")


def project_sessions(observed: DataFrame, project: str) -> DataFrame:
    """Sessions of a project, in any case, active ones first."""
    name = F.lower(F.coalesce(F.nullif(T.stripped("attributed"), F.lit("")), F.lit("unassigned")))
    want = (project.strip() or "unassigned").lower()
    return observed.where(name == want).orderBy(F.desc("active_burst"), F.asc_nulls_last("age_s"), "session_id")


def session_tree(observed: DataFrame) -> DataFrame:
    """Every session with its place: main, child, unlinked or unknown, under its own tool or its parent's.

    A subagent is the child of the main session whose id its parent_thread_id is.
    """
    ids = observed.where("session_id <> ''").groupBy("session_id").agg(F.max(F.struct(T.freshness_rank(F.col("freshness")).alias("r"), F.col("age_s"), "key", "tool", "role")).alias("p"))
    parents = ids.select(F.col("session_id").alias("parent_thread_id"), F.col("p.key").alias("parent_key"), F.col("p.tool").alias("parent_tool"), F.col("p.role").alias("parent_role"))
    both = observed.join(parents, "parent_thread_id", "left")
    child = (F.col("role") == "subagent") & F.coalesce(F.col("parent_role") == "main", F.lit(False))
    place = F.when(F.col("role") == "main", "main").when(child, "child").when(F.col("role") == "subagent", "unlinked").otherwise("unknown")
    return both.select("key", "session_id", "age_s", "freshness", "active_burst", F.when(child, F.col("parent_tool")).otherwise(F.col("tool")).alias("tool"), place.alias("place"), F.when(child, F.col("parent_key")).alias("parent_key"))


def tree_counts(tree: DataFrame) -> DataFrame:
    """Per tool: mains, children, unlinked and unknown sessions."""
    return tree.groupBy("tool").agg(*[F.count_if(F.col("place") == p).alias(n) for p, n in (("main", "mains"), ("child", "children"), ("unlinked", "unlinked"), ("unknown", "unknown"))])


def hidden_counts(tree: DataFrame, linked: int, children: int, unlinked: int) -> DataFrame:
    """Per tool how many sessions a list with these limits leaves out."""
    order = [T.freshness_rank(F.col("freshness")), F.asc_nulls_last("age_s"), F.col("key")]
    mains = tree.where("place = 'main'").withColumn("nth", F.row_number().over(Window.partitionBy("tool").orderBy(*order)))
    kids = tree.where("place = 'child'").groupBy("tool", "parent_key").agg(F.count("*").alias("kids"))
    branches = mains.join(kids.select(F.col("tool"), F.col("parent_key").alias("key"), "kids"), ["tool", "key"], "left").fillna(0, ["kids"])
    cut = F.when(F.col("nth") > linked, F.col("kids") + 1).otherwise(F.greatest(F.lit(0), F.col("kids") - children))
    hidden = branches.groupBy("tool").agg(F.sum(cut).alias("in_branches"))
    rest = tree.groupBy("tool").agg(F.count_if(F.col("place") == "unlinked").alias("u"), F.count_if(F.col("place") == "unknown").alias("n"))
    shown = F.least(F.col("u"), F.lit(unlinked))
    others = (F.col("u") - shown) + F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(1), F.lit(unlinked) - shown))
    return rest.join(hidden, "tool", "left").select("tool", (F.coalesce("in_branches", F.lit(0)) + others).alias("hidden"))


def by_attention(focus: DataFrame) -> DataFrame:
    """Projects with most active bursts first, then attention, then name, with their place."""
    shown = focus.select("project", "active_burst_count", "attention_share_pct")
    return with_place(shown, F.desc("active_burst_count"), F.desc("attention_share_pct"), F.col("project"))


def calibration(current: DataFrame) -> DataFrame:
    """(key, value, pct) of bursts, sessions and processes against the largest of them, at least 1."""
    sums = current.agg(*[F.sum(c).alias(c) for c in ("active_burst_concurrency", "session_concurrency", "pid_concurrency")])
    scale = F.greatest(F.lit(1), *sums.columns)
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value"), (F.col(c).cast("double") * 100 / scale).alias("pct")) for k, c in (("burst", "active_burst_concurrency"), ("session", "session_concurrency"), ("pid", "pid_concurrency"))])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def time_of_day(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events by time of day in a time zone: night, morning, day, evening."""
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), F.timestamp_micros("ts_us").cast("timestamp_ntz")) if zone != "UTC" else None
    hour = F.pmod(F.floor(F.col("ts_us") / 3_600_000_000), F.lit(24)) if local is None else F.hour(local)
    tone = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "day").otherwise("evening")
    return events.groupBy(tone.alias("tone")).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))
