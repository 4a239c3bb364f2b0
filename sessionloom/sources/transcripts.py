"""Transcript files as tables: recursive scans, line reading, candidates, sidecars, process captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as T


def read_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", since=None) -> DataFrame:
    """All non-blank lines of files below ``root``: path, line_no, value, mtime, size; optionally of files changed since a time.

    line_no counts a file's lines from 1, blank ones included, however Spark packs
    files and blocks into tasks, so a line keeps it when the file has grown and is read
    again; a file is numbered in one task. Spark lists no hidden folders on its own, so
    ``root`` has to lead through them, as in ``/home/x/.codex/sessions``.
    """
    in_file = Window.partitionBy("path").orderBy("block", "read")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    lines = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("read"), T.stripped("value").alias("value"),
    )
    if since is not None:
        lines = lines.where(F.col("mtime") >= F.lit(since).cast("timestamp"))
    numbered = lines.withColumn("line_no", F.row_number().over(in_file).cast("long"))
    return numbered.select("path", "mtime", "size", "line_no", "value").where("value <> ''")


def lane_lines(spark: SparkSession, root: str, since=None) -> DataFrame:
    """Lines of the files named events.jsonl below ``root``."""
    return read_lines(spark, root, "events.jsonl", since)


def may_hold_events_after(lines: DataFrame, cutoff_us: int) -> DataFrame:
    """Per path whether its last line with a timestamp, if there is one, lies at or after the cutoff."""
    stamped = lines.withColumn("ts", T.observed_time(T.json_first_field("value", "timestamp")))
    last = stamped.groupBy("path").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("last_ts"))
    return last.select("path", (F.col("last_ts").isNull() | (F.unix_micros("last_ts") >= cutoff_us)).alias("may_hold"))


def candidates(files: DataFrame, priority: DataFrame, foreground_us: int) -> DataFrame:
    """Files (tool, path, mtime_us, may_hold) once each, told apart as priority, deferred or tail-parsed, with their place in the order."""
    marked = files.dropDuplicates(["tool", "path"]).join(priority.select("tool", "path", F.lit(True).alias("priority")).distinct(), ["tool", "path"], "left")
    marked = marked.withColumn("priority", F.coalesce("priority", F.lit(False)))
    old = (F.col("mtime_us") < foreground_us) | ~F.col("may_hold")
    out = marked.withColumn("deferred", ~F.col("priority") & old).withColumn("tail", ~F.col("priority") & ~old)
    return out.orderBy("deferred", F.desc("priority"), F.desc("mtime_us"), "tool", "path")


def sidecar(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The JSON objects in files of this name below ``root``, by directory, as text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", "true").text(root)
    return files.select(T.directory(F.col("_metadata.file_path")).alias("dir"), F.col("value").alias(name.partition(".")[0]))


def lane_traces(lines: DataFrame, requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Traces of lane files (path, line_no, value, mtime) with what their directory's request.json and run.json tell."""
    ids = T.first_non_empty(*[T.json_first_field("value", k) for k in ("thread_id", "session_id", "sessionId")])
    per_file = lines.withColumn("id", F.nullif(ids, F.lit(""))).groupBy("path").agg(
        F.min_by("id", F.when(F.col("id").isNotNull(), F.col("line_no"))).alias("line_id"), F.max("mtime").alias("mtime")
    )
    both = per_file.withColumn("dir", T.directory(F.col("path"))).join(requests, "dir", "left").join(runs, "dir", "left")
    q = lambda *paths: [F.get_json_object("request", "$." + p) for p in paths]
    r = lambda *paths: [F.get_json_object("run", "$." + p) for p in paths]
    first_time = lambda cs: F.coalesce(*[T.observed_time(c) for c in cs])
    requested = first_time([*q("request.requested_at", "invocation.requested_at", "requested_at"), *r("requested_at")])
    started, completed = first_time(r("started_at")), first_time(r("completed_at"))
    named = T.trusted_project(T.first_non_empty(*q("request.contract.project", "contract.project", "request.project", "project"), *r("contract.project", "project")))
    cwd = T.path_project(T.first_non_empty(*q("request.contract.cwd", "contract.cwd", "request.cwd"), *r("contract.cwd", "cwd")))["name"]
    root = T.path_project(T.directory(T.root_of_path("path", ".codex")))["name"]
    times = F.array_sort(F.array_distinct(F.array_compact(F.array(requested, started, completed, F.coalesce("mtime", completed, started)))))
    project = F.when(named != "", named).when(cwd != "", cwd).otherwise(root)
    source = F.when(named != "", "transcript_project").when(cwd != "", "transcript_cwd").when(root != "", "config_root_parent")
    return both.select(
        "path", F.lit("codex").alias("tool"), F.coalesce("line_id", *r("run_id"), T.base_name(F.col("dir"))).alias("session_id"),
        project.alias("project"), source.alias("project_source"), F.lit("subagent").alias("thread_source"),
        F.lit("codexl_lane_path").alias("role_hint_source"), F.explode(times).alias("ts"),
    )


def parse_processes(lines: DataFrame) -> DataFrame:
    """(uid, pid, ppid, command) of captured process lines (line_no, value); the last line of a pid wins.

    Lines may have ``host`` and ``capture`` too: a pid is then one of its host and capture.
    """
    keys = [c for c in ("host", "capture") if c in lines.columns]
    f = lines.select(*keys, "line_no", T.fields("value").alias("f")).where("size(f) >= 4")
    number = lambda i: F.expr(f"if(f[{i}] rlike '^[+-]?[0-9]+$', try_cast(f[{i}] as bigint), null)")
    rows = f.select(*keys, "line_no", number(0).alias("uid"), number(1).alias("pid"), number(2).alias("ppid"), F.array_join(F.slice("f", 4, F.size("f")), " ").alias("command"))
    rows = rows.where("uid >= 0 and pid > 0 and ppid >= 0")
    last = F.max_by(F.struct("uid", "ppid", "command"), "line_no").alias("r")
    return rows.groupBy(*keys, "pid").agg(last).select(*keys, "r.uid", "pid", "r.ppid", "r.command")


def parse_open_files(lines: DataFrame, capture: str) -> DataFrame:
    """(capture, pid, tool, path) from lines ``p<pid>`` and ``n<path>`` of captured listings, once each.

    A capture is one process listing, so its lines are few; captures are the unit of distribution.
    """
    order = Window.partitionBy(capture).orderBy("line_no")
    mark = F.when(F.col("value").startswith("p"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("value", "^p\\s*([0-9]{1,18})\\s*$", 1), F.lit("")), F.lit("999999999999999999")).cast("long"), F.lit(0)))
    filled = lines.withColumn("pid", F.last(mark, ignorenulls=True).over(order))
    files = filled.where("value like 'n%' and length(value) > 1 and pid > 0").withColumn("path", T.clean_path(F.expr("substr(value, 2)")))
    return files.withColumn("tool", T.tool_of_path("path")).where("tool is not null").select(capture, "pid", "tool", "path").distinct()
