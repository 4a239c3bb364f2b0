"""Registered queries: each operator over tables that derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import config
from sessionloom.functions import text as T
from sessionloom.operators import history, indicators, intervals, mapping, redaction, rollups, samples, traces, trends, views
from sessionloom.sources import adapters as A
from sessionloom.sources import appended, transcripts
from sessionloom.streaming import bursts
from sessionloom.streaming import trace_state as state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NOW, GAP, MIN = A.NOW_US, A.GAP_S, A.MIN_S
DAY = 86_400_000_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(c: str, by: str = "|"):
    return F.array_join(c, by).alias(c)


KEYS = ["tool", "session_id"]


def bursts_of(s, d):
    return intervals.burst_spans(A.trace_events(s, d), KEYS, GAP, MIN)


def spans_of(s, d):
    return intervals.session_spans(A.trace_events(s, d), KEYS, MIN)


# intervals


@query
def burst_spans(s, d):
    return bursts_of(s, d).select(*KEYS, "start_us", "end_us", "events")


@query
def late_bursts(s, d):
    e = A.trace_events(s, d)
    late = F.col("event_id") % 5 == 0
    kept = A.land(intervals.burst_spans(e.where(~late), KEYS, GAP, 0).select(*KEYS, "start_us", "end_us", "events"), "bursts")
    return intervals.normalize(bursts.repaired(kept, e.where(late), KEYS, GAP), MIN).select(*KEYS, "start_us", "end_us", "events")


@query
def session_spans(s, d):
    return spans_of(s, d)


@query
def interval_normalize(s, d):
    e = A.trace_events(s, d)
    raw = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts_us")).alias("start_us"), F.when(F.col("event_id") % 5 != 0, F.col("ts_us") + (F.col("event_id") % 2000 - 500) * 1_000_000).alias("end_us"))
    return intervals.normalize(raw, MIN)


@query
def peak_concurrency(s, d):
    return intervals.peak_concurrency(bursts_of(s, d), NOW - 30 * DAY, NOW)


@query
def peak_by_tool(s, d):
    return intervals.peak_concurrency(bursts_of(s, d), NOW - 30 * DAY, NOW, ["tool"])


@query
def historic_peaks(s, d):
    midnight = intervals.day_start(NOW, "UTC")
    parts = []
    for kind, spans in (("session", spans_of(s, d)), ("burst", bursts_of(s, d))):
        for window, start in (("today", midnight), ("seven_day", NOW - 7 * DAY)):
            parts.append(intervals.peak_concurrency(spans, start, NOW).select(F.lit(kind).alias("kind"), F.lit(window).alias("range"), "peak", "peak_at_us"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def concurrency_at(s, d):
    points = A.trace_events(s, d).select(F.col("ts_us").alias("at_us"))
    return intervals.concurrency_at(bursts_of(s, d), points)


@query
def concurrency_series(s, d):
    return intervals.concurrency_series(bursts_of(s, d), NOW - 7 * DAY, NOW, 10_800_000_000)


@query
def trend_grid(s, d):
    last = A.trace_events(s, d).agg(F.max("ts_us").alias("m"))
    points = None
    for label, span, step in config.TREND_SPECS:
        one = intervals.grid(s, NOW - intervals.micros(span), NOW, intervals.micros(step)).select(F.lit(label).alias("range"), "at_us")
        points = one if points is None else points.union(one)
    return points.crossJoin(last).select("range", "at_us", (F.col("at_us") <= F.col("m")).alias("within_data"))


# traces


@query
def json_first_field(s, d):
    lines = A.log_lines(s, d)
    return lines.select("line_no", *[T.json_first_field("value", k).alias(k) for k in ("type", "sessionId", "cwd", "project")])


@query
def ts_parse(s, d):
    stamp = T.json_first_field("value", "timestamp")
    lines = A.log_lines(s, d).withColumn("raw", F.when(F.col("line_no") % 7 == 0, F.replace(stamp, F.lit("Z"), F.lit("+02:00"))).when(F.col("line_no") % 7 == 1, F.substr(stamp, F.lit(1), F.lit(10))).when(F.col("line_no") % 7 == 2, F.replace(stamp, F.lit("."), F.lit(","))).otherwise(stamp))
    return lines.select("line_no", F.unix_micros(T.observed_time("raw")).alias("ts_us"))


@query
def trace_fold(s, d):
    return traces.fold_traces(A.log_lines(s, d)).drop("agent_role", "agent_nickname")


@query
def role_source_normalize(s, d):
    raw = F.expr("element_at(array('Human', ' user', 'MAIN', 'Agent', 'derived ', 'subagent', 'Other', ''), cast(event_id % 8 + 1 as int))")
    return A.trace_events(s, d).groupBy(T.role_source(raw).alias("role_source")).agg(F.count("*").alias("n"))


def _candidates(s, d):
    t = A.traces(s, d)
    files = t.select("tool", "path", (F.col("last_us") + (F.col("user_id") % 3) * 3_600_000_000).alias("mtime_us"), (F.col("last_us") >= NOW - 21_600_000_000).alias("may_hold"))
    priority = A.processes(s, d).select(F.explode("files").alias("f")).select("f.tool", "f.path")
    return transcripts.candidates(files.union(files), priority, NOW - config.foreground_lookback(GAP) * 1_000_000)


@query
def transcript_candidates(s, d):
    return _candidates(s, d).select("tool", "path", "mtime_us", "priority", "deferred", "tail")


@query
def scan_stats(s, d):
    return traces.scan_statistics(_candidates(s, d))


@query
def transcript_tails(s, d):
    files = appended.listing(s, A.transcript_files(s, d), "*.txt")
    held = appended.may_hold_events_after(files, A.NOW_US - 6 * 3_600_000_000, tail_bytes=2048)
    return held.select(F.regexp_extract("path", "session=([^/]+)[.]txt$", 1).alias("session"), "size", "may_hold")


@query
def trace_state(s, d):
    kept = state.traces_by_state(_streamed_lines(s, d), A.new_root(s, "state"))
    return kept.where("events > 0").drop("agent_role", "agent_nickname")


def _streamed_lines(s, d):
    """The files' lines as they are found, each with the path and tool that its session has."""
    lines = appended.appended_lines(s, A.transcript_files(s, d), "*.txt", piece=1 << 20)
    files = A.trace_events(s, d).select(F.col("session_id").alias("session"), "path", "tool").distinct()
    found = lines.select(F.regexp_extract("path", "session=([^/]+)[.]txt$", 1).alias("session"), F.col("at").alias("line_no"), "fresh", "value")
    return found.join(files, "session").drop("session")


# trends


def _start(s, d):
    spans = spans_of(s, d).select("start_us", "end_us").union(bursts_of(s, d).select("start_us", "end_us"))
    return trends.evidence_start(A.trace_events(s, d), spans, NOW - 7 * DAY, NOW)


@query
def evidence_start(s, d):
    return _start(s, d)


@query
def transcript_trends(s, d):
    spans, bursts = A.land(spans_of(s, d), "spans"), A.land(bursts_of(s, d), "bursts")  # every range reads both
    both = spans.select("start_us", "end_us").union(bursts.select("start_us", "end_us"))
    return trends.transcript_trends(spans, bursts, trends.evidence_start(A.trace_events(s, d), both, NOW - 7 * DAY, NOW), NOW)


@query
def trend_coverage(s, d):
    return trends.coverage(_start(s, d), NOW)


def _samples(s, d):
    return history.retained(history.parse(A.history(s, d).withColumnRenamed("hour", "line_no")), NOW)


@query
def runtime_trends(s, d):
    return trends.runtime_trends(_samples(s, d).select("at_us", "pid_concurrency", "mapped_processes"), NOW)


def _points(s, d):
    return trends.runtime_trends(_samples(s, d).select("at_us", "pid_concurrency"), NOW).select("range", "at_us", "pid_concurrency")


@query
def trend_merge(s, d):
    h = _samples(s, d)
    old = h.select("at_us", (F.col("pid_concurrency") * 0).alias("pid_concurrency"), "session_concurrency")
    later = F.col("at_us") + F.floor(F.col("at_us") / 3_600_000_000) % 2 * 1_800_000_000  # those of odd hours lie between two of the history
    new = h.select(later.alias("at_us"), "pid_concurrency", F.lit(None).cast("long").alias("session_concurrency"))
    return trends.merge(old, new, ["pid_concurrency", "session_concurrency"])


@query
def history_trend_points(s, d):
    return trends.history_points(_samples(s, d), ["pid_concurrency", "session_concurrency"])


@query
def confidence_grid(s, d):
    seen = A.land(observed_of(s, d), "observed")
    return rollups.confidence_grid(rollups.project_focus(seen, NOW), seen)


@query
def trend_smooth(s, d):
    return trends.smooth(_points(s, d), ["range"], "pid_concurrency").select("range", "at_us", F.round("smoothed", 6).alias("smoothed"))


@query
def trend_resample(s, d):
    return trends.resample(_points(s, d), ["range"], "pid_concurrency", 12).select("range", "i", F.round("value", 4).alias("value"))


@query
def trend_latest(s, d):
    return trends.latest(_points(s, d), ["range"], "pid_concurrency")


@query
def time_of_day_load(s, d):
    return views.time_of_day(A.trace_events(s, d))


@query
def trend_chosen(s, d):
    return trends.latest(_points(s, d), ["range"], "pid_concurrency", NOW - 30 * 3_600_000_000)


@query
def time_of_day_zones(s, d):
    e = A.trace_events(s, d)
    zones = [views.time_of_day(e, zone).select(F.lit(zone).alias("zone"), "tone", "events", "sessions") for zone in ("UTC", "Asia/Tokyo", "America/Sao_Paulo")]
    return zones[0].union(zones[1]).union(zones[2])


# processes


def _commands(s, d):
    e = A.trace_events(s, d)
    shapes = ["/usr/local/bin/codex --thread-id %08x", "/Applications/Claude.app/Contents/MacOS/Claude --session_id=%08x", "traex sessionid=\"%08x\" CODEX_THREAD_ID=%08x", "/opt/trae/bin/run --home=/home/u/.trae/cli x", "python -m notes /srv/%d/.codex/config", "/Applications/Sparkle Updater.app/codex", "", "'/Applications/My Term.app/x' --home /srv/a/.codex /home/b/.claude"]
    expr = "case event_id % 8 " + " ".join(f"when {i} then format_string('{c.replace(chr(39), chr(92) + chr(39))}'{', event_id' * c.count('%')})" for i, c in enumerate(shapes)) + " end"
    return e.select("event_id", "user_id", F.expr(expr).alias("command"))


@query
def process_parse(s, d):
    e = A.trace_events(s, d)
    line = F.expr("case when event_id % 6 = 0 then concat('  501 ', user_id, ' ', event_id % 50) when event_id % 6 = 1 then concat('x ', user_id, ' 1 cmd') else concat('  ', event_id % 3 - 1, '  ', user_id, ' ', event_id % 50, '   /usr/bin/tool   --n ', event_id) end")
    return transcripts.parse_processes(e.select(F.col("event_id").alias("line_no"), line.alias("value")))


@query
def process_files(s, d):
    e = A.trace_events(s, d)
    line = F.expr(f"case when event_id % 5 = 0 then concat('p', 100 + event_id % 90) when event_id % 5 = 4 then 'n/etc/hosts' when event_id % 35 = 3 then 'pbad' else concat('n', {A.PATH}) end")
    lines = e.select((F.col("user_id") % 20).alias("capture"), F.col("event_id").alias("line_no"), line.alias("value"))
    return transcripts.parse_open_files(lines, "capture")


@query
def tool_detect(s, d):
    return _commands(s, d).select("event_id", T.tool_of_command("command").alias("tool"))


@query
def path_classify(s, d):
    e = A.trace_events(s, d)
    path = F.expr(f"case when event_id % 4 = 0 then replace({A.PATH}, '.jsonl', '.txt') when event_id % 4 = 1 then concat('/srv/a/.codex/.codexl/run', user_id, '/events.jsonl') else {A.PATH} end")
    return e.select("event_id", T.tool_of_path(path).alias("tool"))


@query
def session_hints(s, d):
    return _commands(s, d).select("event_id", F.array_join(T.session_hints(F.col("command")), "|").alias("hints"))


@query
def config_roots(s, d):
    return _roots(s, d)


@query
def config_roots_found(s, d):
    return mapping.found_roots(_roots(s, d), A.trace_events(s, d).select("path"))


def _roots(s, d):
    c = _commands(s, d).withColumn("tool", T.tool_of_command("command"))
    known = s.createDataFrame([("codex", "/srv/known/.codex")], "tool string, root string")
    procs = c.select("tool", "command", F.expr("cast(array() as array<struct<tool:string,path:string>>)").alias("files"))
    files = A.processes(s, d).select("tool", F.lit("").alias("command"), "files")
    return mapping.known_roots(known, procs.union(files))


@query
def fallback_id(s, d):
    e = A.trace_events(s, d)
    path = F.expr("case event_id % 3 when 0 then path when 1 then concat('/srv/a/.codex/.codexl/run', user_id, '/events.jsonl') else concat('/srv/b/.codex/sessions/plain-', user_id, '.jsonl') end")
    return e.select("event_id", T.fallback_id(F.lit("codex"), path).alias("id"))


@query
def host_ancestor(s, d):
    users = A.trace_events(s, d).select("user_id").distinct()
    p = users.select((F.col("user_id") + 2).alias("pid"), F.expr("if(user_id % 50 = 7, user_id + 2, user_id div 2 + 1)").alias("ppid"), F.expr("case when user_id % 9 = 4 then concat('/Applications/Term', user_id, '.app/Contents/x -l') when user_id % 9 = 5 then concat('run /Applications/Other', user_id, '.app') else 'zsh' end").alias("command"))
    return mapping.host_ancestors(p)


# mapping


def _sessions(s, d):
    return mapping.process_sessions(A.processes(s, d), A.traces(s, d))


def _counts(s, d):
    return mapping.process_counts(A.processes(s, d), _sessions(s, d))


def observed_of(s, d):
    return mapping.observe(mapping.live_sessions(_sessions(s, d), A.traces(s, d), NOW, GAP), NOW, GAP)


@query
def process_session_map(s, d):
    return _sessions(s, d).select("pid", "key", "tool", "session_id", "path", *mapping.FLAGS)


@query
def mapping_conflicts(s, d):
    return mapping.mapping_notes(A.processes(s, d), A.traces(s, d))


@query
def process_mapping_counts(s, d):
    return _counts(s, d).select("pid", "tool", joined("session_ids"), joined("session_paths"), "mapped_sessions")


@query
def live_sessions(s, d):
    return mapping.ordered_sessions(observed_of(s, d)).select("key", "tool", "session_id", "freshness", "process_count", "age_s", F.col("attributed").alias("project"), joined("provenance"), "mapping_method")


@query
def transcript_only_sessions(s, d):
    return observed_of(s, d).where("transcript_activity and process_count = 0").select("key", "tool", "session_id")


@query
def session_freshness(s, d):
    return observed_of(s, d).select("key", "freshness", "active_burst", "stale", "recent", "missing_transcript", "confidence", joined("confidence_reasons"))


@query
def session_role(s, d):
    return observed_of(s, d).select("key", "role", "role_confidence", joined("role_reasons"))


# attribution and rollups


@query
def project_from_path(s, d):
    path = F.expr("case when user_id % 5 = 0 then concat('/home/u/.claude/projects/x', user_id, '/a.jsonl') when user_id % 5 = 1 then '/home/u/.claude/projects/--/a.jsonl' else path end")
    return A.traces(s, d).select("user_id", T.project_of_storage(path).alias("project"))


@query
def path_project_name(s, d):
    path = F.expr("element_at(array(concat('/srv/w', user_id, '/'), concat('/home/u', user_id), '/', concat('/srv//a/./b', user_id), '/srv/.hidden', '/x/Tmp', concat('/Users/n', user_id), ''), cast(user_id % 8 + 1 as int))")
    return A.traces(s, d).withColumn("p", T.path_project(path)).select("user_id", "p.name", "p.reason")


@query
def project_attribution(s, d):
    return observed_of(s, d).select("key", F.col("attributed").alias("project"), F.col("attribution_source").alias("source"), F.col("attribution_confidence").alias("confidence"), F.array_join("attribution_reasons", "|").alias("reasons"))


@query
def current_by_tool(s, d):
    return rollups.current_by_tool(A.processes(s, d), observed_of(s, d), NOW, GAP)


@query
def current_metrics(s, d):
    return current_by_tool(s, d).agg(*[F.sum(c).alias(c) for c in ("pid_concurrency", "session_concurrency", "active_burst_concurrency")])


@query
def snapshot_summary(s, d):
    return rollups.summary(_counts(s, d), observed_of(s, d))


@query
def age_buckets(s, d):
    return rollups.age_buckets(observed_of(s, d), NOW, GAP).select("label", "sessions")


def _focus(s, d):
    return rollups.project_focus(A.land(observed_of(s, d), "observed"), NOW)


@query
def project_focus(s, d):
    plain = ["project", "session_count", "active_burst_count", "main_agent_sessions", "subagent_sessions", "unknown_role_sessions", "stale_session_count", "recent_session_count", "process_count", "basis", "attention_share_pct", "age_s", "confidence", "attribution_confidence"]
    return _focus(s, d).select(*plain, joined("confidence_reasons"), joined("attribution_reasons"))


@query
def project_tools(s, d):
    return rollups.project_tools(observed_of(s, d))


@query
def attention_basis(s, d):
    return rollups.attention_basis(observed_of(s, d))


def _workitems(s, d):
    return rollups.candidate_workitems(observed_of(s, d))


@query
def candidate_workitems(s, d):
    return _workitems(s, d).select("key", "project", "tool", "freshness", "session_count", "process_count", "confidence", joined("session_ids"), joined("reasons"), joined("attribution_reasons"))


@query
def confidence_breakdown(s, d):
    return rollups.breakdown(observed_of(s, d), "confidence", config.CONFIDENCE_RANK).select("level", "n")


@query
def provenance_summary(s, d):
    return rollups.breakdown(observed_of(s, d).select(F.explode("provenance").alias("provenance")), "provenance", config.PROVENANCE).select("level", "n")


@query
def attribution_sources(s, d):
    return rollups.breakdown(observed_of(s, d), "attribution_source", config.SOURCE_RANK).select("level", "n")


# indicators


def _peak(s, d):
    peaks = historic_peaks(s, d).where("kind = 'session'").select(F.concat("range", F.lit("_transcript_peak")).alias("source"), F.col("peak").alias("value"))
    return indicators.load_peak(observed_of(s, d).agg(F.count("*").alias("value")), peaks)


def _risk(s, d):
    seen, counts = A.land(observed_of(s, d), "observed"), _counts(s, d)  # read by every indicator
    peaks = historic_peaks(s, d).where("kind = 'session'").select(F.concat("range", F.lit("_transcript_peak")).alias("source"), F.col("peak").alias("value"))
    peak = indicators.load_peak(seen.agg(F.count("*").alias("value")), peaks)
    return indicators.coordination_risk(counts, seen, rollups.project_focus(seen, NOW), rollups.candidate_workitems(seen), peak, GAP)


@query
def coordination_risk(s, d):
    return _risk(s, d).drop("details")


@query
def risk_signals(s, d):
    return indicators.risk_signals(_risk(s, d), GAP)


@query
def top_project(s, d):
    return indicators.top_project(_focus(s, d))


@query
def duplicate_overlap(s, d):
    return indicators.duplicate_overlap(observed_of(s, d))


@query
def workitem_coverage(s, d):
    return indicators.workitem_coverage(_workitems(s, d), observed_of(s, d))


@query
def load_peak(s, d):
    return _peak(s, d)


@query
def snapshot_notes(s, d):
    return indicators.session_notes(_counts(s, d), observed_of(s, d), 3)


# history


@query
def history_load_stats(s, d):
    return history.load_statistics(history.parse(A.history(s, d).withColumnRenamed("hour", "line_no")), NOW)


@query
def history_dedup(s, d):
    return _samples(s, d).drop("projects", "at")


@query
def history_range(s, d):
    return history.in_range(_samples(s, d), NOW - 3 * DAY, NOW - DAY).select("at_us", "pid_concurrency")


@query
def history_allocation(s, d):
    out = history.allocation(history.in_range(_samples(s, d), NOW - 7 * DAY, NOW))
    return out.withColumn("average_share_pct", F.round("average_share_pct", 6))


@query
def history_whole(s, d):
    h = A.trace_events(s, d).groupBy((F.floor(F.col("ts_us") / 3_600_000_000) * 3_600_000_000).alias("at_us")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("u"), F.min("project").alias("p"))
    snapshots = h.select(
        "at_us", F.struct(F.col("n").alias("pid_concurrency"), F.col("u").alias("session_concurrency")).alias("current"), F.struct(F.col("u").alias("active_sessions"), (F.col("n") / 4).alias("mapping_coverage_pct")).alias("summary"),
        F.struct(F.coalesce("p", F.lit("")).alias("top_project"), (F.col("n") % 7).alias("stale_session_count"), F.when(F.col("n") % 2 == 0, "transcript_burst").alias("load_peak_source")).alias("coordination_risk"),
        F.array(F.struct(F.coalesce("p", F.lit("")).alias("project"), (F.col("u") % 3).alias("main_agent_sessions"))).alias("projects"),
    )
    root, batch = A.new_root(s, "samples"), F.floor(F.col("at_us") / 3_600_000_000) % 3
    for number in range(3):
        samples.land_batch(snapshots.where(batch == number), root, number)
        if number == 1:
            samples.compact(s, root)
    r = F.col("coordination_risk")
    return samples.stored(s, root).select(
        "at_us", "current.pid_concurrency", "current.session_concurrency", "current.active_burst_concurrency", "summary.active_sessions", "summary.mapping_coverage_pct", r["top_project"].alias("top_project"), r["stale_session_count"].alias("stale_session_count"),
        r["load_peak_source"].alias("load_peak_source"), r["fragmentation_pct"].alias("fragmentation_pct"), F.col("projects")[0]["main_agent_sessions"].alias("main_agent_sessions"),
    )


@query
def history_growth(s, d):
    return history.growth(history.in_range(_samples(s, d), NOW - 7 * DAY, NOW))


@query
def history_peaks(s, d):
    return history.peaks(_samples(s, d))


# views


@query
def redact_text(s, d):
    return A.table(s, d, "pages").select("page_id", T.redact_text(F.concat(F.lit("see file:///var/data/p"), F.col("page_id"), F.lit("/x.html, cwd:/srv/w"), F.col("page_id") % 7, F.lit(" or (/tmp/) from "), F.col("url"), F.lit(" "), F.col("html"))).alias("text"))


@query
def redact_command(s, d):
    return A.processes(s, d).select("pid", T.redact_command("command").alias("command"))


@query
def redact_sessions(s, d):
    return views.redacted_sessions(observed_of(s, d)).withColumn("reasons", F.array_join("reasons", "|"))


@query
def redact_tables(s, d):
    p, n = A.processes(s, d), (F.col("pid") % 7).cast("string")
    project = F.concat(F.lit("/srv/p"), n, F.lit("/"))
    rows = p.select(
        "pid", "command", F.col("files.path").alias("session_paths"), F.struct(F.col("tool").alias("name"), F.concat(F.lit("/Applications/"), "tool", F.lit(".app")).alias("bundle_path")).alias("host_app"),
        F.array(F.struct(F.concat(F.lit("project="), project, F.lit("|tool="), "tool").alias("key"), project.alias("project"), F.array(F.concat(F.lit("seen in (/tmp/u"), n, F.lit("/s.jsonl), twice")), F.lit("by id")).alias("confidence_reasons"))).alias("workitems"),
    )
    w = F.col("workitems")[0]
    return redaction.redacted(rows).select("pid", "command", F.size("session_paths").alias("paths"), "host_app.name", "host_app.bundle_path", w["key"].alias("key"), w["project"].alias("project"), F.array_join(w["confidence_reasons"], "; ").alias("reasons"))


@query
def entity_search(s, d):
    return views.search(observed_of(s, d), A.processes(s, d), "P3")


@query
def project_sessions(s, d):
    return views.project_sessions(observed_of(s, d), "P3").select("key", "freshness")


@query
def session_tree(s, d):
    return views.tree_counts(views.session_tree(A.land(observed_of(s, d), "observed")))


@query
def session_tree_hidden(s, d):
    return views.hidden_counts(A.land(views.session_tree(A.land(observed_of(s, d), "observed")), "tree"), 3, 1, 2)


@query
def role_matrix(s, d):
    return rollups.role_matrix(observed_of(s, d))


@query
def tool_mix(s, d):
    return rollups.tool_mix(observed_of(s, d))


@query
def projects_by_attention(s, d):
    return views.by_attention(_focus(s, d))


@query
def calibration(s, d):
    return views.calibration(current_by_tool(s, d))


@query
def refresh_slot(s, d):
    e = A.trace_events(s, d).withColumn("ts", F.timestamp_micros("ts_us"))
    return e.select("event_id", T.refresh_slot(F.col("ts"), 300).alias("slot"), T.refresh_slot(F.col("ts"), 700).alias("odd_slot"))


@query
def refresh_slot_dedup(s, d):
    e = A.trace_events(s, d).withColumn("slot", T.refresh_slot(F.timestamp_micros("ts_us"), 3600))
    return e.groupBy("slot").agg(F.min("ts_us").alias("first_us"))


@query
def duration_label(s, d):
    return spans_of(s, d).select(*KEYS, T.duration_label(F.floor((F.col("end_us") - F.col("start_us")) / 1_000_000)).alias("label"))
