"""Session-log tables derived from the given star-schema tables, so that every query grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.landing import land, new_root  # noqa: F401
from sessionloom.operators.intervals import us
from sessionloom.sources.appended import write_files

#: The clock of all queries over ``events``, and the idle gap and least interval that suit its spacing.
NOW = "2024-01-30 22:00:00"
NOW_US = 1_706_652_000_000_000
GAP_S, MIN_S = 7200, 900
#: Folders over which transcript files are dealt.
FOLDERS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PATH = """case user_id % 3
    when 0 then concat('/home/u', user_id, '/.claude/projects/-home-dev-p', user_id % 7, '/u', user_id, '.jsonl')
    when 1 then concat('/srv/p', user_id % 7, '/.codex/sessions/2024/01/rollout-2024-01-01T00-00-00-u', user_id, '.jsonl')
    else concat('/srv/p', user_id % 7, '/.trae/cli/sessions/u', user_id, '.jsonl') end"""


def trace_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per logged event: path, tool, session_id, project, its source, roles, time."""
    e = table(spark, folder, "events")
    return e.select(
        "event_id", "user_id", F.expr(PATH).alias("path"),
        F.expr("element_at(array('claude', 'codex', 'trae'), cast(user_id % 3 + 1 as int))").alias("tool"),
        F.expr("concat('u', user_id)").alias("session_id"),
        F.expr("if(user_id % 11 = 0, null, concat('p', user_id % 7))").alias("project"),
        F.expr("case when user_id % 11 = 0 then null when user_id % 5 < 2 then 'transcript_project' when user_id % 5 < 4 then 'transcript_cwd' else 'transcript_path' end").alias("project_source"),
        F.expr("case user_id % 4 when 0 then 'user' when 1 then 'subagent' end").alias("thread_source"),
        F.expr("if(user_id % 10 > 6, concat('u', user_id - user_id % 10), null)").alias("parent_thread_id"),
        F.expr("if(user_id % 13 = 0, 'codexl_lane_path', null)").alias("role_hint_source"),
        F.expr("user_id % 4 = 2").alias("independently_run"),
        F.col("event_type").alias("kind"), us("ts").alias("ts_us"), "value",
    )


TRACE = ["path", "tool", "session_id", "project", "project_source", "thread_source", "parent_thread_id", "role_hint_source", "independently_run"]


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """One row per transcript, with its first and last event."""
    return trace_events(spark, folder).groupBy("user_id", *TRACE).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("events")
    )


def processes(spark: SparkSession, folder: str) -> DataFrame:
    """Running processes with their open transcripts and the session ids their commands mention."""
    users = trace_events(spark, folder).select("user_id", "path", "tool").distinct().where("user_id % 4 <> 0")
    other = "named_struct('tool', 'codex', 'path', concat('/srv/x/.codex/sessions/rollout-2024-01-01T00-00-00-u', user_id, '.jsonl'))"
    own = "named_struct('tool', tool, 'path', path)"
    return users.select(
        (F.col("user_id") + 10_000).alias("pid"), F.expr("10000 + user_id div 10").alias("ppid"), "tool",
        F.expr(f"case user_id % 5 when 0 then if(user_id % 10 = 0, array({own}, {other}), array({own})) when 1 then array({other}) when 3 then array({own}) else cast(array() as array<struct<tool:string,path:string>>) end").alias("files"),
        F.expr("case when user_id % 10 = 1 or user_id % 5 = 2 then array(concat('u', user_id)) when user_id % 10 = 6 then array('u999999') when user_id % 5 = 3 then array(concat('u', user_id + 1)) else cast(array() as array<string>) end").alias("hints"),
        F.expr("format_string('/opt/bin/%s --session-id=%08x --cwd=/home/dev/p%d -v resume /tmp/u%d write notes', tool, user_id, user_id % 7, user_id)").alias("command"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON log lines (path, line_no, value) whose fields come and go from line to line."""
    e = trace_events(spark, folder)
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = [
        F.concat(F.lit('{"type":"'), F.col("kind"), F.lit('","timestamp":"'), F.when(F.col("event_id") % 9 == 0, "").otherwise(stamp), F.lit('"')),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"sessionId":"'), F.col("session_id"), F.lit('"'))),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit(',"payload":{"cwd":"/srv/w'), (F.col("event_id") % 5).cast("string"), F.lit('"}'))),
        F.when(F.col("event_id") % 7 == 2, F.concat(F.lit(',"project":"q'), (F.col("event_id") % 3).cast("string"), F.lit('"'))),
        F.when(F.col("event_id") % 10 == 3, F.concat(F.lit(',"thread_source":"'), F.when(F.col("event_id") % 20 == 3, "Human").otherwise("agent"), F.lit('"'))),
        F.when(F.col("event_id") % 25 == 4, F.concat(F.lit(',"parent_thread_id":"u'), (F.col("event_id") % 6).cast("string"), F.lit('"'))),
        F.lit("}"),
    ]
    return e.select("path", "tool", F.col("event_id").alias("line_no"), F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))


def transcript_files(spark: SparkSession, folder: str) -> str:
    """A root below which each session's log lines are a text file ``session=<id>.txt``, in a fixed number of folders, as files of a tool are by project or day."""
    root = new_root(spark, "transcripts")
    lines = log_lines(spark, folder).withColumn("session", F.regexp_extract("path", "(u[0-9]+)\\.jsonl$", 1))
    file = F.format_string("%03d/session=%s.txt", F.pmod(F.xxhash64("session"), F.lit(FOLDERS)), "session")
    write_files(lines.repartition("session").sortWithinPartitions("session", "line_no").select(file.alias("file"), "value"), root)
    return root


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly history samples as JSON text lines: counts of events and users, and the projects' shares."""
    e = trace_events(spark, folder).withColumn("hour", F.floor(F.col("ts_us") / 3_600_000_000))
    projects = e.groupBy("hour", F.coalesce("project", F.lit("")).alias("project")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("s"))
    total = projects.groupBy("hour").agg(F.sum("n").alias("total"))
    nested = projects.join(total, "hour").groupBy("hour").agg(
        F.array_sort(F.collect_list(F.struct("project", F.col("s").alias("session_count"), F.col("n").alias("active_burst_count"), F.col("n").alias("process_count"), (F.col("n") * 1000 / F.col("total") / 10).alias("attention_share_pct")))).alias("projects")
    )
    current = e.groupBy("hour").agg(F.count("*").alias("pid_concurrency"), F.count_distinct("session_id").alias("session_concurrency"), F.count_distinct("tool").alias("active_burst_concurrency"), F.count_if(F.col("value") > 100).alias("mapped"), F.count_if(~(F.col("value") > 100)).alias("unmapped"))
    stamp = F.date_format(F.timestamp_seconds(F.col("hour") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return current.join(nested, "hour").select(
        "hour",
        F.to_json(F.struct(
            F.when(F.col("hour") % 50 == 0, F.lit("yesterday")).otherwise(stamp).alias("at"),
            F.struct("pid_concurrency", "session_concurrency", "active_burst_concurrency").alias("current"),
            F.struct(F.col("mapped").alias("mapped_processes"), F.col("unmapped").alias("unmapped_processes")).alias("summary"),
            "projects",
        )).alias("value"),
    )
