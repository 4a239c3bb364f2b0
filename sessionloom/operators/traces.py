"""Log lines folded into one trace per transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as T

#: Fields that a line has anywhere, and those of its objects.
OWN = ("type", "timestamp", "sessionId", "session_id", "project", "cwd", "thread_source", "parent_thread_id", "agent_role", "agent_nickname")
NESTED = {
    "message": ("project", "cwd"),
    "payload": ("id", "session_id", "sessionId", "project", "cwd", "thread_source", "parent_thread_id", "agent_role", "agent_nickname"),
    "thread_spawn": ("parent_thread_id",),
    "subagent": ("parent_thread_id",),
}


def line_facts(lines: DataFrame, *more) -> DataFrame:
    """What one line of a transcript says: time, id, project names by source, roles, whether it is an event; and ``more`` columns.

    A line without a valid time says nothing. Nested fields are those of the first object of their parent's name, at any depth; lines of
    claude have theirs below ``message``, the fields beside it going first, and say nothing of roles; the others below ``payload``, which goes first.
    """
    claude = F.col("tool") == "claude"
    objects = {f"in_{p}": F.when(claude if p == "message" else ~claude, T.json_object("value", p)) for p in ("message", "payload", "thread_spawn", "subagent")}
    own, of = lambda key: F.col(f"own_{key}"), lambda parent, key: F.col(f"{parent}_{key}")
    # a field is a column before it is used: inside of conditions each use would search the line again
    lines = lines.withColumns(objects | {f"own_{key}": T.json_first_field("value", key) for key in OWN})
    lines = lines.withColumns({"time": T.observed_time(own("timestamp"))} | {f"{parent}_{key}": T.json_first_field(f"in_{parent}", key) for parent, keys in NESTED.items() for key in keys})
    time = F.col("time")
    by_tool = lambda one, other: F.when(time.isNotNull(), F.nullif(F.when(claude, one).otherwise(other), F.lit("")))
    beside = lambda key: by_tool(T.first_non_empty(own(key), of("message", key)), T.first_non_empty(of("payload", key), own(key)))
    role = lambda key: by_tool(F.lit(""), T.first_non_empty(of("payload", key), own(key)))
    active = F.when(claude, T.active_type(own("type"))).otherwise(F.lit(True))
    parents = T.first_non_empty(of("thread_spawn", "parent_thread_id"), of("subagent", "parent_thread_id"), of("payload", "parent_thread_id"), own("parent_thread_id"))
    spawned = F.when(F.col("value").contains("thread_spawn"), T.first_non_empty(own("parent_thread_id"), parents)).otherwise(parents)
    ids = T.first_non_empty(of("payload", "id"), of("payload", "session_id"), of("payload", "sessionId"), own("session_id"), own("sessionId"))
    blank = lambda c: F.nullif(c, F.lit(""))
    storage = F.when(claude & time.isNotNull(), T.project_of_storage("path"))
    lines = lines.withColumns({"said_project": beside("project"), "said_cwd": beside("cwd"), "said_thread_source": role("thread_source"), "storage": storage})
    lines = lines.withColumn("cwd_name", F.when(F.col("said_cwd").isNotNull(), T.path_project("said_cwd")["name"]))
    return lines.select(
        "path", "tool", "line_no", F.unix_micros(time).alias("ts_us"), (time.isNotNull() & active).alias("is_event"),
        by_tool(T.first_non_empty(own("sessionId"), own("session_id")), ids).alias("session_id"),
        blank(T.trusted_project("said_project")).alias("named"), blank("cwd_name").alias("cwd"),
        blank(T.trusted_project("storage")).alias("stored"),
        blank(T.role_source("said_thread_source")).alias("thread_source"), by_tool(F.lit(""), spawned).alias("parent_thread_id"),
        role("agent_role").alias("agent_role"), role("agent_nickname").alias("agent_nickname"), *more,
    )


def named_by_file(session_id: str = "session_id"):
    """The session id that lines gave, else the one that the file's name gives."""
    return F.coalesce(session_id, T.fallback_id(F.col("tool"), F.col("path")))


def fold_traces(lines: DataFrame) -> DataFrame:
    """One trace per path.

    Ids, roles and names are those of the last line that has one, an id else that of the file's name; the project is
    the last one of the strongest source seen; the first role evidence names its
    source; independently_run is false once any line speaks for a parent. Paths without events are left out.
    """
    facts = line_facts(lines)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    names = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(rank).alias("rank"), F.col("line_no").alias("line"), F.col(c).alias("name"), F.lit(source).alias("source")))
        for c, rank, source in (("named", 5, "transcript_project"), ("cwd", 4, "transcript_cwd"), ("stored", 3, "transcript_path"))
    ]))
    facts = facts.withColumn("best", F.array_max(names))
    hint = F.when(F.col("thread_source").isNotNull(), "thread_source").when(F.col("parent_thread_id").isNotNull(), "parent_thread_id")
    facts = facts.withColumn("hint", hint)
    return (
        facts.groupBy("path", "tool")
        .agg(
            last("session_id"), last("thread_source"), last("parent_thread_id"), last("agent_role"), last("agent_nickname"),
            F.max("best").alias("best"), F.min_by("hint", F.when(F.col("hint").isNotNull(), F.col("line_no"))).alias("role_hint_source"),
            F.every(F.coalesce((F.coalesce("thread_source", F.lit("")) != "subagent") & F.col("parent_thread_id").isNull(), F.lit(True))).alias("independently_run"),
            F.count_distinct(F.when(F.col("is_event"), F.col("ts_us"))).alias("events"),
            F.min(F.when(F.col("is_event"), F.col("ts_us"))).alias("first_us"), F.max(F.when(F.col("is_event"), F.col("ts_us"))).alias("last_us"),
        )
        .where("events > 0")
        .withColumn("session_id", named_by_file()).withColumn("project", F.col("best.name")).withColumn("project_source", F.col("best.source")).drop("best")
    )


def by_id(traces: DataFrame) -> DataFrame:
    """One trace per (tool, session_id), and host where there is one: the one with the latest event, then the smallest path."""
    keys = [*T.hosts(traces), "tool", "session_id"]
    rank = F.struct(F.col("last_us"), F.lit(0).alias("x"))
    best = traces.where("session_id is not null").groupBy(*keys).agg(F.max(rank).alias("r"))
    same = traces.join(best, keys).where(F.col("last_us").eqNullSafe(F.col("r.last_us")))
    return same.groupBy(*keys).agg(F.min("path").alias("path"))


def scan_statistics(candidates: DataFrame) -> DataFrame:
    """Counts of files scanned, parsed, deferred and tail-parsed, and of those with an ``error``, where there is such a column."""
    failed = [F.count_if(F.col("error").isNotNull()).alias("failed_files")] if "error" in candidates.columns else []
    return candidates.agg(
        F.count("*").alias("scanned_files"), F.count_if(~F.col("deferred")).alias("parsed_files"),
        F.count_if("deferred").alias("deferred_files"), F.count_if("tail").alias("tail_files"), *failed,
    )
