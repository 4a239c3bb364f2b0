"""Which sessions a process belongs to, by ranked evidence, and the live sessions that follow.

Where processes have a column ``host``, each host's process ids, paths and sessions
are its own, and all results carry the host; traces are then matched by host if they have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import config
from sessionloom.functions import text as T
from sessionloom.operators.traces import by_id

FLAGS = ("transcript_path", "transcript_activity", "parsed_transcript_id", "command_hint", "fallback_session_id")


def id_key(tool, session_id):
    return F.concat_ws(":", F.lit("id"), tool, session_id)


def path_key(tool, path):
    return F.concat_ws(":", F.lit("path"), tool, path)


def file_evidence(processes: DataFrame, traces: DataFrame) -> DataFrame:
    """One row per process and open transcript with the rule that decides on it.

    A parsed transcript id is strongest; next to one, a file without keeps only if its name gives the
    same id; else a sole command hint; else the id in the file name.
    """
    own, told = T.hosts(processes), T.hosts(processes, traces)
    files = processes.select(*own, "pid", F.col("tool").alias("process_tool"), T.sorted_set("hints").alias("hints"), F.explode("files").alias("f"))
    files = files.select(*own, "pid", "process_tool", "hints", F.col("f.tool").alias("tool"), F.col("f.path").alias("path"))
    known = traces.select(*told, "path", F.nullif(T.stripped("session_id"), F.lit("")).alias("trace_id"), F.lit(True).alias("traced"))
    files = files.join(known, [*told, "path"], "left").withColumn("fallback", F.nullif(T.fallback_id(F.col("tool"), F.col("path")), F.lit("")))
    mine = Window.partitionBy(*own, "pid")
    parsed = F.collect_set(F.when(F.col("trace_id").isNotNull(), id_key("tool", "trace_id"))).over(mine)
    files = files.withColumn("parsed_keys", parsed)
    rule = (
        F.when(F.col("trace_id").isNotNull(), "parsed")
        .when(F.size("parsed_keys") > 0, F.when(F.array_contains("parsed_keys", id_key("tool", "fallback")), "sibling").otherwise("dropped"))
        .when(F.size("hints") == 1, "hint")
        .when(F.col("fallback").isNotNull(), "fallback")
        .otherwise("none")
    )
    return files.withColumn("rule", rule)


def process_sessions(processes: DataFrame, traces: DataFrame) -> DataFrame:
    """(pid, key, tool, session_id, path, trace_path, the five flags) of every process's sessions."""
    own, told = T.hosts(processes), T.hosts(processes, traces)
    files = file_evidence(processes, traces)
    hint = F.element_at("hints", 1)
    session = F.when(F.col("rule") == "parsed", F.col("trace_id")).when(F.col("rule") == "hint", hint).when(F.col("rule").isin("sibling", "fallback"), F.col("fallback"))
    hinted = F.coalesce(F.array_contains("hints", F.col("fallback")), F.lit(False))
    by_path = (F.col("rule") == "none") | ((F.col("rule") == "fallback") & ~hinted)
    found = files.where("rule <> 'dropped'").select(
        *own, "pid", F.when(by_path, path_key("tool", "path")).otherwise(id_key("tool", session)).alias("key"), "tool", session.alias("session_id"), "path",
        F.when(F.col("traced"), F.col("path")).alias("trace_path"), F.lit(True).alias("transcript_path"), F.lit(False).alias("transcript_activity"),
        (F.col("rule") == "parsed").alias("parsed_transcript_id"),
        ((F.col("rule") == "hint") | ((F.col("rule") == "fallback") & hinted)).alias("command_hint"),
        (F.col("rule").isin("sibling", "fallback") | ((F.col("rule") == "hint") & F.coalesce(F.col("fallback") == hint, F.lit(False)))).alias("fallback_session_id"),
    )
    hints = processes.select(*own, "pid", "tool", F.size("files").alias("n_files"), F.explode(T.sorted_set("hints")).alias("session_id"))
    hints = hints.withColumn("key", id_key("tool", "session_id"))
    ids = by_id(traces).select(*told, id_key("tool", "session_id").alias("key"), F.col("path").alias("trace_path"))
    no = lambda *cs: {c: F.lit(c == "command_hint") for c in cs}
    alone = hints.where("n_files = 0").withColumn("path", F.lit(None).cast("string"))
    joined = hints.where("n_files > 0").join(found.select(*own, "pid", "key").distinct(), [*own, "pid", "key"]).withColumn("path", F.lit(None).cast("string"))
    extra = alone.unionByName(joined).join(ids, [*told, "key"], "left").withColumns(no(*FLAGS)).select(found.columns)
    every = found.unionByName(extra)
    merged = every.groupBy(*own, "pid", "key").agg(
        F.min("tool").alias("tool"), F.min("session_id").alias("session_id"), F.min("path").alias("path"), F.min("trace_path").alias("trace_path"),
        *[F.bool_or(f).alias(f) for f in FLAGS],
    )
    return merged.withColumn("path", F.coalesce("path", "trace_path"))


def mapping_notes(processes: DataFrame, traces: DataFrame) -> DataFrame:
    """(pid, note) where weaker evidence was passed over."""
    own = T.hosts(processes)
    files = file_evidence(processes, traces)
    hint = F.element_at("hints", 1)
    passed = files.where((F.col("rule") == "hint") & F.col("fallback").isNotNull() & (F.col("fallback") != hint)).select(
        *own, "pid", F.format_string('%d (%s): the id %s in the name of %s gave way to the hint %s', "pid", "process_tool", "fallback", "path", hint).alias("note")
    )
    won = files.where("rule = 'parsed'").groupBy(*own, "pid", "process_tool", "hints").agg(
        F.array_sort(F.collect_set("trace_id")).alias("ids"), F.collect_set(id_key("tool", "trace_id")).alias("keys")
    )
    text = F.array_join("ids", ", ")
    lost = won.withColumn("hint", F.explode("hints")).where(~F.array_contains("keys", id_key("process_tool", "hint"))).select(
        *own, "pid", F.format_string('%d (%s): the hint %s gave way to %s in its transcripts', "pid", "process_tool", "hint", text).alias("note")
    )
    return passed.union(lost).distinct()


def process_counts(processes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every process with its distinct session ids and paths; most sessions first."""
    own = T.hosts(processes)
    per = sessions.groupBy(*own, "pid").agg(F.array_sort(F.collect_set("session_id")).alias("session_ids"), F.array_sort(F.collect_set("path")).alias("session_paths"))
    out = processes.select(*own, "pid", "tool").join(per, [*own, "pid"], "left").withColumn("mapped_sessions", F.coalesce(F.size("session_ids"), F.lit(0)))
    empty = F.array().cast("array<string>")
    out = out.withColumns({"session_ids": F.coalesce("session_ids", empty), "session_paths": F.coalesce("session_paths", empty)})
    return out.withColumn("mapped_sessions", F.greatest("mapped_sessions", F.lit(0))).orderBy(F.desc("mapped_sessions"), "tool", *own, "pid")


def live_sessions(sessions: DataFrame, traces: DataFrame, now_us: int, gap_s: int) -> DataFrame:
    """Sessions of running processes, and recent transcripts that no process is mapped to, with their traces."""
    own, told = T.hosts(sessions), T.hosts(sessions, traces)
    with_trace = sessions.groupBy(*own, "key").agg(
        F.min("tool").alias("tool"), F.min("session_id").alias("session_id"), F.min("path").alias("path"), F.min("trace_path").alias("trace_path"),
        F.array_sort(F.collect_set("pid")).alias("pids"), *[F.bool_or(f).alias(f) for f in FLAGS],
    )
    low, high = now_us - config.recent_window(gap_s) * 1_000_000, now_us + gap_s * 1_000_000
    named = F.nullif(T.stripped("session_id"), F.lit(""))
    recent = traces.where(F.col("last_us").between(low, high)).select(
        *told,
        F.when(named.isNotNull(), id_key("tool", named)).otherwise(path_key("tool", "path")).alias("key"), "tool",
        F.coalesce(named, T.fallback_id(F.col("tool"), F.col("path"))).alias("session_id"), "path", F.col("path").alias("trace_path"),
        F.array().cast("array<bigint>").alias("pids"), F.lit(True).alias("transcript_path"), F.lit(True).alias("transcript_activity"),
        named.isNotNull().alias("parsed_transcript_id"), F.lit(False).alias("command_hint"), F.lit(False).alias("fallback_session_id"),
        "last_us",
    )
    newest = F.max_by(F.struct(*[c for c in recent.columns if c not in (*told, "key", "last_us")]), F.struct("last_us", "path"))  # of traces with one key
    recent = recent.groupBy(*told, "key").agg(newest.alias("t")).select(*told, "key", "t.*")
    every = with_trace.unionByName(recent.join(with_trace, [*told, "key"], "left_anti"), allowMissingColumns=True)
    facts = traces.select(*told, F.col("path").alias("trace_path"), "project", "project_source", "thread_source", "parent_thread_id", "role_hint_source", "independently_run", "first_us", "last_us")
    return every.join(facts, [*told, "trace_path"], "left").withColumn("path", F.coalesce("path", "trace_path"))


def observe(sessions: DataFrame, now_us: int, gap_s: int) -> DataFrame:
    """Freshness, confidence, role, project attribution and provenance of live sessions."""
    age = F.when(F.col("last_us").isNotNull(), F.greatest(F.lit(0), F.lit(now_us) - F.col("last_us")))
    gap = (gap_s if gap_s > 0 else config.IDLE_GAP_S) * 1_000_000
    missing = F.col("last_us").isNull()
    freshness = F.when(missing, "unknown").when(age <= gap, "active").when(age <= config.stale_after(gap_s) * 1_000_000, "idle").otherwise("stale")
    recent = F.coalesce(F.col("first_us").between(now_us - config.recent_window(gap_s) * 1_000_000, now_us), F.lit(False))
    method = F.when(F.col("parsed_transcript_id"), "transcript_path").when(F.col("command_hint"), "command_hint").when(F.col("fallback_session_id"), "fallback_session_id").when(F.col("transcript_path"), "transcript_path").otherwise("fallback_session_id")
    base = F.when(F.col("parsed_transcript_id"), 3).when(F.col("command_hint"), 2).otherwise(1)
    level = F.greatest(base - missing.cast("int"), F.lit(1))
    confidence = F.when(level == 3, "high").when(level == 2, "medium").otherwise("low")
    provenance = F.array_compact(F.array(*[F.when(F.col(p), p) for p in config.PROVENANCE]))
    provenance = F.when(F.size(provenance) == 0, F.array(F.lit("fallback_session_id"))).otherwise(provenance)
    weak = ~F.col("parsed_transcript_id") & ~F.col("command_hint")
    reasons = F.array_compact(F.array(
        F.when(F.col("fallback_session_id"), F.when(weak, "id_from_file_name").otherwise("file_name_agrees")),
        F.when(F.col("command_hint") & ~F.col("parsed_transcript_id"), "id_from_command"),
        F.when(missing, "no_event_times"),
    ))
    return project_attribution(roles(sessions.withColumns({
        "freshness": freshness, "active_burst": freshness == "active", "stale": freshness == "stale", "recent": recent, "missing_transcript": missing,
        "age_s": F.floor(age / 1_000_000), "mapping_method": method, "confidence": confidence, "confidence_reasons": reasons, "provenance": provenance,
        "process_count": F.size("pids"),
    })))


def roles(sessions: DataFrame) -> DataFrame:
    """main, subagent or unknown, with confidence and reasons."""
    none = F.col("trace_path").isNull()
    source = T.text("thread_source")
    parent, lane = T.text("parent_thread_id") != "", T.text("role_hint_source") == "codexl_lane_path"
    stated = source.isin("subagent", "user")
    sub = (source == "subagent") | parent | lane
    alone = ~stated & ~parent & ~lane & F.coalesce(F.col("independently_run"), F.lit(False))
    role = F.when(none, "unknown").when(sub, "subagent").when((source == "user") | alone, "main").otherwise("unknown")
    confidence = F.when(none, "low").when(stated | parent, "high").when(lane | alone, "medium").otherwise("low")
    bare = ~stated & ~parent & ~lane & ~alone
    present = bare & (T.text("session_id") != "") & (F.size("pids") > 0)
    reasons = F.array_compact(F.array(
        F.when(none, "no_trace"), F.when(~none & stated, F.concat(F.lit("thread_source="), source)),
        F.when(~none & parent, "has_parent_thread"), F.when(~none & lane, "lane_file"),
        F.when(~none & alone, "runs_alone"), F.when(~none & present, "process_without_role"),
        F.when(~none & bare & ~present, "no_role_evidence"),
    ))
    return sessions.withColumns({"role": role, "role_confidence": confidence, "role_reasons": F.array_sort(F.array_distinct(reasons))})


def project_attribution(sessions: DataFrame) -> DataFrame:
    """The trace's trusted project, else the parent of the configuration root in the path, else unassigned."""
    named = T.trusted_project("project")
    source = F.when(T.text("project_source").isin(*config.SOURCE_RANK), T.text("project_source")).otherwise("transcript_project")
    why = T.lookup(source, {
        "transcript_project": "named_in_transcript", "transcript_cwd": "working_directory",
        "transcript_path": "storage_path", "config_root_parent": "root_parent",
    }, "in_transcript")
    root = F.when(T.text("path") != "", T.config_root_project("path"))
    sessions = sessions.withColumn("root", root)
    rooted, reason = F.coalesce("root.name", F.lit("")), F.coalesce("root.reason", F.lit(""))
    none = T.sorted_set(F.array(reason, F.lit("no_project_evidence")))
    return sessions.withColumns({
        "attributed": F.when(named != "", named).when(rooted != "", rooted).otherwise("unassigned"),
        "attribution_source": F.when(named != "", source).when(rooted != "", "config_root_parent").otherwise("unassigned"),
        "attribution_reasons": F.when(named != "", F.array(why)).when(rooted != "", F.array(reason)).otherwise(none),
    }).withColumn("attribution_confidence", T.source_confidence(F.col("attribution_source"))).drop("root")


def ordered_sessions(observed: DataFrame) -> DataFrame:
    """Freshest first, then most processes, youngest, project, tool, id."""
    return observed.orderBy(T.freshness_rank(F.col("freshness")), F.desc("process_count"), F.asc_nulls_last("age_s"), "attributed", "tool", "session_id")


def host_ancestors(processes: DataFrame, bundles: DataFrame | None = None, steps: int = 12) -> DataFrame:
    """Each process's nearest ancestor, itself included, that runs from an application bundle: pid, host_pid, bundle.

    Looks at ``steps`` processes at most. ``bundles`` (bundle) names those that exist, if given. Every round
    doubles how far each process sees: it takes over what the ancestor at its end
    sees. A cycle only leads to processes seen before.
    """
    h = T.hosts(processes)
    own = processes.select(*h, "pid", "ppid", T.bundle_of_command("command").alias("bundle"))
    if bundles is not None:
        own = own.join(bundles.select("bundle", F.lit(True).alias("there")), "bundle", "left").withColumn("bundle", F.when(F.col("there"), F.col("bundle")).otherwise("")).drop("there")
    hit = F.when(F.col("bundle") != "", F.struct(F.lit(0).alias("far"), F.col("pid").alias("host_pid"), "bundle"))
    at, seen = own.select(*h, "pid", F.when(F.col("ppid") > 0, F.col("ppid")).alias("up"), hit.alias("hit")), 1
    while seen < steps:
        above = at.select(*h, F.col("pid").alias("up"), F.col("up").alias("next"), F.col("hit").alias("further"))
        beyond = F.when(F.col("further").isNotNull(), F.struct((F.col("further.far") + seen).alias("far"), "further.host_pid", "further.bundle"))
        at = at.join(above, [*h, "up"], "left").select(*h, "pid", F.col("next").alias("up"), F.coalesce("hit", beyond).alias("hit"))
        seen *= 2
    return at.where(F.col("hit.far") < steps).select(*h, "pid", "hit.host_pid", "hit.bundle")


def known_roots(known: DataFrame, processes: DataFrame) -> DataFrame:
    """(tool, root) of known roots, commands' roots and open transcripts' roots, once each."""
    of_command = processes.select("tool", F.explode(T.config_roots(F.col("tool"), F.col("command"))).alias("root"))
    files = processes.select(F.explode("files").alias("f")).select("f.tool", "f.path")
    marker = {"claude": ".claude", "codex": ".codex", "trae": ".trae/cli"}
    root = F.lit("")
    for tool, name in marker.items():
        root = F.when(F.col("tool") == tool, T.root_of_path("path", name)).otherwise(root)
    of_files = files.select("tool", root.alias("root")).where("root <> ''")
    return known.select("tool", "root").union(of_command).union(of_files).distinct()


def found_roots(roots: DataFrame, listing: DataFrame) -> DataFrame:
    """Those of the roots (tool, root) that a listing of files (path) shows to be there: some file lies below them.

    The listing stands for asking a file system about each root: every file gives the directories above it, once each after a map-side
    distinct, and roots are matched to those by equality. Roots without any file below them don't show and are left out.
    """
    parts = F.split(T.clean_path("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    directories = listing.where("path like '%/%'").select(F.explode(above).alias("dir")).where("dir <> ''").distinct()
    return roots.join(directories, T.clean_path("root") == F.col("dir"), "left_semi")
