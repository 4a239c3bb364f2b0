"""The queries as DuckDB SQL over the same tables, written apart from the operators."""

from __future__ import annotations

NOW = 1_706_652_000_000_000
GAP, MIN, DAY, HOUR = 7_200_000_000, 900_000_000, 86_400_000_000, 3_600_000_000
SPECS = "(VALUES ('1D', 86400, 1800), ('3D', 259200, 5400), ('7D', 604800, 10800), ('15D', 1296000, 21600), ('30D', 2592000, 43200)) s(rng, span_s, step_s)"

BASE = f"""WITH ev AS (
  SELECT event_id, user_id, 'u' || user_id AS session_id, ['claude', 'codex', 'trae'][user_id % 3 + 1] AS tool,
    CASE user_id % 3 WHEN 0 THEN '/home/u' || user_id || '/.claude/projects/-home-dev-p' || user_id % 7 || '/u' || user_id || '.jsonl'
      WHEN 1 THEN '/srv/p' || user_id % 7 || '/.codex/sessions/2024/01/rollout-2024-01-01T00-00-00-u' || user_id || '.jsonl'
      ELSE '/srv/p' || user_id % 7 || '/.trae/cli/sessions/u' || user_id || '.jsonl' END AS path,
    epoch_us(ts) AS ts_us, event_type AS kind, value FROM events),
tr AS (SELECT user_id, session_id, tool, path, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ev GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {GAP} THEN 0 ELSE 1 END AS opens FROM ev WINDOW w AS (PARTITION BY tool, session_id ORDER BY ts_us)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY tool, session_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
bursts AS (SELECT tool, session_id, min(ts_us) AS start_us, greatest(max(ts_us), min(ts_us) + {MIN}) AS end_us, count(*) AS events FROM runs GROUP BY tool, session_id, run),
spans AS (SELECT tool, session_id, min(ts_us) AS start_us, greatest(max(ts_us), min(ts_us) + {MIN}) AS end_us FROM ev GROUP BY tool, session_id),
users AS (SELECT DISTINCT user_id, tool, path FROM ev),
pr AS (SELECT user_id, user_id + 10000 AS pid, tool, path, user_id % 5 AS k,
    CASE WHEN user_id % 10 = 1 OR user_id % 5 = 2 THEN 'u' || user_id WHEN user_id % 10 = 6 THEN 'u999999' WHEN user_id % 5 = 3 THEN 'u' || (user_id + 1) END AS hint,
    '/srv/x/.codex/sessions/rollout-2024-01-01T00-00-00-u' || user_id || '.jsonl' AS other FROM users WHERE user_id % 4 <> 0),
-- by kind: 0 its own transcript (and for even tens another file of the same id), 1 another file, 2 a hint alone, 3 its own against a hint, 4 nothing
ps AS (
  SELECT pid, 'id:' || tool || ':u' || user_id AS key, tool, 'u' || user_id AS session_id, path, path AS trace_path, true AS transcript_path, false AS transcript_activity,
    true AS parsed_transcript_id, false AS command_hint, k = 0 AND user_id % 10 = 0 AND tool = 'codex' AS fallback_session_id FROM pr WHERE k IN (0, 3)
  UNION ALL SELECT pid, 'id:codex:' || hint, 'codex', hint, other, NULL, true, false, false, true, hint = 'u' || user_id FROM pr WHERE k = 1
  UNION ALL SELECT pid, 'id:' || tool || ':' || hint, tool, hint, path, path, false, false, false, true, false FROM pr WHERE k = 2),
px AS (SELECT ps.pid, ps.key, ps.tool, ps.session_id, ps.path, coalesce(ps.trace_path, CASE WHEN ps.tool = p.tool AND ps.session_id = 'u' || p.user_id AND p.tool = 'codex' THEN p.path END) AS trace_path,
    transcript_path, transcript_activity, parsed_transcript_id, command_hint, fallback_session_id FROM ps JOIN pr p USING (pid)),
mapped AS (SELECT key, any_value(tool) AS tool, any_value(session_id) AS session_id, min(path) AS path, min(trace_path) AS trace_path, list_sort(list(DISTINCT pid)) AS pids,
    bool_or(transcript_path) AS transcript_path, bool_or(transcript_activity) AS transcript_activity, bool_or(parsed_transcript_id) AS parsed, bool_or(command_hint) AS hinted, bool_or(fallback_session_id) AS fell FROM px GROUP BY key),
alone AS (SELECT 'id:' || tool || ':' || session_id AS key, tool, session_id, path, path AS trace_path, []::BIGINT[] AS pids, true AS transcript_path, true AS transcript_activity, true AS parsed, false AS hinted, false AS fell
    FROM tr WHERE last_us BETWEEN {NOW} - {HOUR} AND {NOW} + {GAP} AND 'id:' || tool || ':' || session_id NOT IN (SELECT key FROM mapped)),
live AS (SELECT l.*, t.user_id AS u, t.first_us, t.last_us, greatest(0, {NOW} - t.last_us) AS age_us FROM (SELECT * FROM mapped UNION ALL SELECT * FROM alone) l LEFT JOIN tr t ON t.path = l.trace_path),
obs AS (SELECT *, len(pids) AS process_count, last_us IS NULL AS missing,
    CASE WHEN last_us IS NULL THEN 'unknown' WHEN age_us <= {GAP} THEN 'active' WHEN age_us <= 3 * {GAP} THEN 'idle' ELSE 'stale' END AS freshness,
    coalesce(first_us BETWEEN {NOW} - {HOUR} AND {NOW}, false) AS recent,
    CASE greatest(1, CASE WHEN parsed THEN 3 WHEN hinted THEN 2 ELSE 1 END - (last_us IS NULL)::INT) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN u IS NULL THEN 'unknown' WHEN u % 4 = 1 OR u % 10 > 6 OR u % 13 = 0 THEN 'subagent' WHEN u % 4 IN (0, 2) THEN 'main' ELSE 'unknown' END AS role,
    CASE WHEN u % 11 <> 0 THEN 'p' || u % 7 WHEN tool = 'codex' AND path LIKE '/srv/p%' THEN 'p' || u % 7 WHEN path LIKE '/srv/x/%' THEN 'x' ELSE 'unassigned' END AS project,
    CASE WHEN u % 11 <> 0 THEN CASE WHEN u % 5 < 2 THEN 'transcript_project' WHEN u % 5 < 4 THEN 'transcript_cwd' ELSE 'transcript_path' END
      WHEN tool = 'codex' AND (path LIKE '/srv/p%' OR path LIKE '/srv/x/%') THEN 'config_root_parent' ELSE 'unassigned' END AS source,
    list_filter([CASE WHEN transcript_path THEN 'transcript_path' END, CASE WHEN transcript_activity THEN 'transcript_activity' END, CASE WHEN hinted THEN 'command_hint' END, CASE WHEN fell THEN 'fallback_session_id' END], lambda x: x IS NOT NULL) AS provenance
    FROM live),
ob AS (SELECT *, CASE WHEN source IN ('transcript_project', 'transcript_cwd') THEN 'high' WHEN source = 'transcript_path' THEN 'medium' ELSE 'low' END AS source_confidence,
    CASE WHEN last_us IS NOT NULL THEN age_us // 1000000 END AS age_s FROM obs),
pids AS (SELECT unnest(pids) AS pid, project, tool FROM ob),
basis AS (SELECT CASE WHEN (SELECT count(DISTINCT pid) FROM pids) > 0 AND (SELECT max(n) FROM (SELECT count(DISTINCT project) AS n FROM pids GROUP BY pid)) <= 1 THEN 'process_count' ELSE 'session_count' END AS basis),
den AS (SELECT basis, CASE basis WHEN 'process_count' THEN (SELECT count(DISTINCT pid) FROM pids) ELSE (SELECT count(*) FROM ob) END AS denominator FROM basis),
focus AS (SELECT project, count(*) AS session_count, count(*) FILTER (freshness = 'active') AS active_burst_count,
    count(*) FILTER (role = 'main') AS main_agent_sessions, count(*) FILTER (role = 'subagent') AS subagent_sessions, count(*) FILTER (role = 'unknown') AS unknown_role_sessions,
    count(*) FILTER (freshness = 'stale') AS stale_session_count, count(*) FILTER (recent) AS recent_session_count,
    coalesce(any_value(n), 0) AS process_count, any_value(basis) AS basis, any_value(denominator) AS denominator, min(age_s) AS age_s,
    count(*) FILTER (confidence = 'high') AS ch, count(*) FILTER (confidence = 'medium') AS cm, count(*) FILTER (confidence = 'low') AS cl, count(*) FILTER (missing) AS miss,
    count(*) FILTER (source IN ('transcript_project', 'transcript_cwd')) AS sh, count(*) FILTER (source = 'transcript_path') AS sm, count(*) FILTER (source = 'config_root_parent') AS sr, count(*) FILTER (source = 'unassigned') AS su
    FROM ob LEFT JOIN (SELECT project, count(DISTINCT pid) AS n FROM pids GROUP BY project) USING (project), den GROUP BY project),
focus2 AS (SELECT *, CASE WHEN basis = 'process_count' THEN process_count ELSE session_count END * 1000.0::DOUBLE / denominator / 10 AS share FROM focus),
work AS (SELECT project, tool, freshness, count(*) AS session_count, sum(process_count)::BIGINT AS process_count,
    CASE WHEN bool_or(confidence = 'low') THEN 'low' WHEN bool_or(confidence = 'medium') OR count(*) > 1 THEN 'medium' ELSE 'high' END AS confidence,
    array_to_string(list_sort(list(DISTINCT session_id)), '|') AS session_ids, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (missing) AS miss,
    count(*) FILTER (source IN ('transcript_project', 'transcript_cwd')) AS sh, count(*) FILTER (source = 'transcript_path') AS sm, count(*) FILTER (source = 'config_root_parent') AS sr, count(*) FILTER (source = 'unassigned') AS su
    FROM ob GROUP BY project, tool, freshness),
hist AS (SELECT ts_us // {HOUR} AS hour, count(*) AS pid_concurrency, count(DISTINCT session_id) AS session_concurrency, count(DISTINCT tool) AS active_burst_concurrency,
    count(*) FILTER (value > 100) AS mapped_processes, count(*) FILTER (NOT (value > 100)) AS unmapped_processes FROM ev GROUP BY 1),
samples AS (SELECT hour * {HOUR} AS at_us, * FROM hist WHERE hour % 50 <> 0 AND hour * {HOUR} >= {NOW} - 30 * {DAY}),
ranges AS (SELECT rng AS range, {NOW} - span_s::BIGINT * 1000000 AS from_us, step_s::BIGINT * 1000000 AS step_us, step_s FROM {SPECS}),
grid AS (SELECT range, unnest(generate_series(from_us, {NOW}, step_us)) AS at_us FROM ranges),
buckets AS (SELECT range, (at_us - from_us) // step_us AS bucket, at_us, pid_concurrency, mapped_processes FROM samples, ranges WHERE at_us BETWEEN from_us AND {NOW}
    QUALIFY row_number() OVER (PARTITION BY range, bucket ORDER BY at_us DESC) = 1),
start AS (SELECT min(ts) AS start_us FROM (SELECT min(ts_us) AS ts FROM ev WHERE ts_us BETWEEN {NOW} - 7 * {DAY} AND {NOW}
    UNION ALL SELECT min(greatest(start_us, {NOW} - 7 * {DAY})) FROM (SELECT start_us, end_us FROM spans UNION ALL SELECT start_us, end_us FROM bursts) WHERE end_us >= {NOW} - 7 * {DAY} AND start_us <= {NOW}))
"""


def reasons(sr: str = "sr", sm: str = "sm", su: str = "su", sh: str = "sh") -> str:
    return f"""array_to_string(list_sort(list_filter([CASE WHEN {sr} > 0 THEN 'root_parent:' || {sr} END,
      CASE WHEN {sm} > 0 THEN 'storage_path:' || {sm} END, CASE WHEN {su} > 0 THEN 'unassigned:' || {su} END,
      CASE WHEN ({sh} > 0)::INT + ({sm} > 0)::INT + ({sr} + {su} > 0)::INT > 1 THEN 'mixed_sources' END], lambda x: x IS NOT NULL)), '|')"""


def peak(spans: str, low: str, high: str, key: str = "") -> str:
    """Peak by a global sweep: at each change, the running sum of starts less ends."""
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    return f"""SELECT {k}max(level)::BIGINT AS peak, min_by(at_us, (-level, at_us)) AS peak_at_us FROM (
      SELECT {k}at_us, sum(net) OVER ({part}ORDER BY at_us) AS level FROM (SELECT {k}at_us, sum(chg) AS net FROM (
        SELECT {k}greatest(start_us, {low}) AS at_us, 1 AS chg FROM {spans} WHERE end_us > {low} AND start_us < {high}
        UNION ALL SELECT {k}least(end_us, {high}), -1 FROM {spans} WHERE end_us > {low} AND start_us < {high}) GROUP BY ALL)) {f'GROUP BY {key}' if key else ''}"""


def level(spans: str, grid: str) -> str:
    """Open spans at each point of a grid by comparing all, spans clipped to the grid; none is open at its last point."""
    return f"""SELECT g.range, g.at_us, count(s.start_us) AS level FROM {grid} g JOIN (SELECT range, min(at_us) AS lo FROM {grid} GROUP BY 1) USING (range)
      LEFT JOIN {spans} s ON g.at_us < {NOW} AND s.end_us > lo AND s.start_us < {NOW} AND greatest(s.start_us, lo) <= g.at_us AND least(s.end_us, {NOW}) > g.at_us GROUP BY ALL"""


LINE = """'{"type":"' || kind || '","timestamp":"' || CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') END || '"'"""
ROLE = "['user', 'user', 'user', 'subagent', 'subagent', 'subagent', 'other', ''][event_id % 8 + 1]"

SQL = {
    "burst_spans": "SELECT * FROM bursts",
    "session_spans": "SELECT * FROM spans",
    "interval_normalize": f"""SELECT event_id, st AS start_us, greatest(en, st + {MIN}) AS end_us FROM (SELECT event_id,
        CASE WHEN event_id % 3 <> 0 THEN ts_us WHEN event_id % 5 <> 0 THEN ts_us + (event_id % 2000 - 500) * 1000000 END AS st,
        CASE WHEN event_id % 5 <> 0 THEN ts_us + (event_id % 2000 - 500) * 1000000 ELSE ts_us END AS en FROM ev) WHERE st IS NOT NULL""",
    "peak_concurrency": peak("bursts", f"({NOW} - 30 * {DAY})", str(NOW)),
    "peak_by_tool": peak("bursts", f"({NOW} - 30 * {DAY})", str(NOW), "tool"),
    "historic_peaks": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, '{rng}' AS range, * FROM ({peak(spans, low, str(NOW))})"
        for kind, spans in (("session", "spans"), ("burst", "bursts")) for rng, low in (("today", f"({NOW} - {NOW} % {DAY})"), ("seven_day", f"({NOW} - 7 * {DAY})"))
    ),
    "concurrency_at": """SELECT at_us, level::BIGINT AS level FROM (SELECT at_us, max(asked) AS asked, sum(sum(change)) OVER (ORDER BY at_us) AS level FROM (
        SELECT ts_us AS at_us, 0 AS change, true AS asked FROM ev UNION ALL SELECT start_us, 1, false FROM bursts UNION ALL SELECT end_us, -1, false FROM bursts) GROUP BY at_us) WHERE asked""",
    "concurrency_series": f"SELECT at_us, level FROM ({level('bursts', '(SELECT * FROM grid WHERE range = chr(55) || chr(68))')})",
    "trend_grid": "SELECT range, at_us, at_us <= (SELECT max(ts_us) FROM ev) AS within_data FROM grid",
    "json_first_field": """SELECT event_id AS line_no, kind AS type, CASE WHEN event_id % 3 = 0 THEN session_id ELSE '' END AS "sessionId",
        CASE WHEN event_id % 4 = 1 THEN '/srv/w' || event_id % 5 ELSE '' END AS cwd, CASE WHEN event_id % 7 = 2 THEN 'q' || event_id % 3 ELSE '' END AS project FROM ev""",
    "ts_parse": "SELECT event_id AS line_no, CASE WHEN event_id % 9 = 0 OR event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 0 THEN ts_us - 7200000000 ELSE ts_us END AS ts_us FROM ev",
    "role_source_normalize": f"SELECT {ROLE} AS role_source, count(*) AS n FROM ev GROUP BY 1",
    "transcript_candidates": f"""SELECT tool, path, mtime_us, priority, NOT priority AND old AS deferred, NOT priority AND NOT old AS tail FROM (
        SELECT tool, path, last_us + (user_id % 3) * {HOUR} AS mtime_us, user_id % 4 <> 0 AND user_id % 5 IN (0, 3) AS priority,
        last_us + (user_id % 3) * {HOUR} < {NOW} - 21600000000 OR last_us < {NOW} - 21600000000 AS old FROM tr)""",
    "scan_stats": f"""SELECT count(*) AS scanned_files, count(*) FILTER (NOT (NOT p AND old)) AS parsed_files, count(*) FILTER (NOT p AND old) AS deferred_files, count(*) FILTER (NOT p AND NOT old) AS tail_files
        FROM (SELECT user_id % 4 <> 0 AND user_id % 5 IN (0, 3) AS p, last_us < {NOW} - 21600000000 AS old FROM tr)""",
    "evidence_start": "SELECT start_us FROM start",
    "trend_coverage": f"SELECT range, from_us, step_s, start_us <= from_us AS complete, ({NOW} - start_us) // {HOUR} AS lookback_hours FROM ranges, start",
    "transcript_trends": f"""SELECT range, at_us, CASE WHEN at_us >= start_us THEN a.level END AS sessions, CASE WHEN at_us >= start_us THEN b.level END AS bursts
        FROM ({level('spans', 'grid')}) a JOIN ({level('bursts', 'grid')}) b USING (range, at_us), start""",
    "runtime_trends": "SELECT * FROM buckets",
    "trend_merge": """SELECT at_us, coalesce(n.pid_concurrency, 0) AS pid_concurrency, o.session_concurrency FROM samples o
        FULL JOIN (SELECT at_us + at_us // 3600000000 % 2 * 1800000000 AS at_us, pid_concurrency FROM samples) n USING (at_us)""",
    "trend_chosen": f"SELECT range, coalesce(max(at_us) FILTER (at_us = {NOW} - 30 * {HOUR}), max(at_us)) AS at_us, coalesce(max(pid_concurrency) FILTER (at_us = {NOW} - 30 * {HOUR}), max_by(pid_concurrency, at_us)) AS pid_concurrency FROM buckets GROUP BY 1",
    "time_of_day_zones": """SELECT zone, CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'day' ELSE 'evening' END AS tone, count(*) AS events, count(DISTINCT session_id) AS sessions
        FROM (SELECT zone, hour(make_timestamp(ts_us + shift * 3600000000)) AS h, session_id FROM ev, (VALUES ('UTC', 0), ('Asia/Tokyo', 9), ('America/Sao_Paulo', -3)) z(zone, shift)) GROUP BY ALL""",
    "trend_smooth": """SELECT range, at_us, round(CASE WHEN n < 4 OR p1 IS NULL OR n1 IS NULL THEN v ELSE (coalesce(p2, p1) + 2 * p1 + 3 * v + 2 * n1 + coalesce(n2, n1)) / 9 END, 6) AS smoothed FROM (
        SELECT range, at_us, pid_concurrency::DOUBLE AS v, count(*) OVER (PARTITION BY range) AS n, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2, lead(v) OVER w AS n1, lead(v, 2) OVER w AS n2 FROM buckets WINDOW w AS (PARTITION BY range ORDER BY at_us))""",
    "trend_resample": """SELECT range, i::INT AS i, round(CASE WHEN r.at_us > l.at_us THEN l.v + (r.v - l.v) * ((x - l.at_us) / (r.at_us - l.at_us)) ELSE l.v END, 4) AS value FROM (
        SELECT range, i, lo + (hi - lo) * i / 11 AS x FROM (SELECT range, min(at_us)::DOUBLE AS lo, max(at_us)::DOUBLE AS hi FROM buckets GROUP BY 1), range(12) t(i)) p,
        LATERAL (SELECT at_us::DOUBLE AS at_us, pid_concurrency::DOUBLE AS v FROM buckets b WHERE b.range = p.range AND b.at_us <= x ORDER BY b.at_us DESC LIMIT 1) l,
        LATERAL (SELECT at_us::DOUBLE AS at_us, pid_concurrency::DOUBLE AS v FROM buckets b WHERE b.range = p.range AND b.at_us >= x ORDER BY b.at_us LIMIT 1) r""",
    "trend_latest": "SELECT range, max(at_us) AS at_us, max_by(pid_concurrency, at_us) AS pid_concurrency FROM buckets GROUP BY 1",
    "time_of_day_load": "SELECT CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'day' ELSE 'evening' END AS tone, count(*) AS events, count(DISTINCT session_id) AS sessions FROM (SELECT hour(make_timestamp(ts_us)) AS h, session_id FROM ev) GROUP BY 1",
    "process_parse": "SELECT event_id % 3 - 1 AS uid, user_id AS pid, event_id % 50 AS ppid, '/usr/bin/tool --n ' || event_id AS command FROM ev WHERE event_id % 6 > 1 AND event_id % 3 > 0 AND user_id > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "process_files": """SELECT DISTINCT capture, pid, tool, path FROM (SELECT *, last_value(CASE WHEN event_id % 5 = 0 THEN 100 + event_id % 90 WHEN event_id % 5 <> 4 AND event_id % 35 = 3 THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS pid, user_id % 20 AS capture FROM ev) WHERE event_id % 5 NOT IN (0, 4) AND event_id % 35 <> 3 AND pid > 0""",
    "tool_detect": "SELECT event_id, ['codex', 'claude', 'trae', 'trae', '', '', '', ''][event_id % 8 + 1] AS tool FROM ev",
    "path_classify": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'codex' ELSE tool END AS tool FROM ev",
    "session_hints": "SELECT event_id, CASE WHEN event_id % 8 < 3 THEN printf('%08x', event_id) ELSE '' END AS hints FROM ev",
    "fallback_id": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN session_id WHEN 1 THEN 'run' || user_id ELSE 'plain-' || user_id END AS id FROM ev",
    "process_session_map": "SELECT pid, key, tool, session_id, path, transcript_path, transcript_activity, parsed_transcript_id, command_hint, fallback_session_id FROM px",
    "mapping_conflicts": """SELECT pid, pid || ' (' || tool || '): the id u' || user_id || ' in the name of ' || other || ' gave way to the hint ' || hint AS note FROM pr WHERE k = 1 AND hint <> 'u' || user_id
        UNION ALL SELECT pid, pid || ' (' || tool || '): the hint ' || hint || ' gave way to u' || user_id || ' in its transcripts' FROM pr WHERE k = 3""",
    "process_mapping_counts": "SELECT pid, pr.tool, coalesce(session_id, '') AS session_ids, coalesce(px.path, '') AS session_paths, (session_id IS NOT NULL)::INT AS mapped_sessions FROM pr LEFT JOIN px USING (pid)",
    "live_sessions": "SELECT key, tool, session_id, freshness, process_count::INT AS process_count, age_s, project, array_to_string(provenance, '|') AS provenance, CASE WHEN parsed THEN 'transcript_path' WHEN hinted THEN 'command_hint' ELSE 'fallback_session_id' END AS mapping_method FROM ob",
    "transcript_only_sessions": "SELECT key, tool, session_id FROM alone",
    "session_freshness": """SELECT key, freshness, freshness = 'active' AS active_burst, freshness = 'stale' AS stale, recent, missing AS missing_transcript, confidence,
        array_to_string(list_filter([CASE WHEN fell AND NOT parsed AND NOT hinted THEN 'id_from_file_name' WHEN fell THEN 'file_name_agrees' END,
        CASE WHEN hinted AND NOT parsed THEN 'id_from_command' END, CASE WHEN missing THEN 'no_event_times' END], lambda x: x IS NOT NULL), '|') AS confidence_reasons FROM ob""",
    "session_role": """SELECT key, role, CASE WHEN u IS NULL THEN 'low' WHEN u % 4 < 2 OR u % 10 > 6 THEN 'high' WHEN u % 13 = 0 OR u % 4 = 2 THEN 'medium' ELSE 'low' END AS role_confidence,
        array_to_string(list_sort(list_filter([CASE WHEN u IS NULL THEN 'no_trace' END, CASE WHEN u % 4 = 0 THEN 'thread_source=user' WHEN u % 4 = 1 THEN 'thread_source=subagent' END,
        CASE WHEN u % 10 > 6 THEN 'has_parent_thread' END, CASE WHEN u % 13 = 0 THEN 'lane_file' END,
        CASE WHEN u % 4 = 2 AND u % 10 <= 6 AND u % 13 <> 0 THEN 'runs_alone' END,
        CASE WHEN u % 4 = 3 AND u % 10 <= 6 AND u % 13 <> 0 THEN CASE WHEN process_count > 0 THEN 'process_without_role' ELSE 'no_role_evidence' END END], lambda x: x IS NOT NULL)), '|') AS role_reasons FROM ob""",
    "project_from_path": "SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'x' || user_id WHEN 1 THEN 'unknown' ELSE CASE WHEN tool = 'claude' THEN 'p' || user_id % 7 ELSE 'unknown' END END AS project FROM tr",
    "path_project_name": """SELECT user_id, ['w' || user_id, '', '', 'b' || user_id, '', '', '', ''][user_id % 8 + 1] AS name, ['', 'home_directory', 'root_path', '',
        'no_named_directory', 'generic_directory:Tmp', 'home_directory', 'root_path'][user_id % 8 + 1] AS reason FROM tr""",
    "project_attribution": """SELECT key, project, source, source_confidence AS confidence, CASE source WHEN 'transcript_project' THEN 'named_in_transcript'
        WHEN 'transcript_cwd' THEN 'working_directory' WHEN 'transcript_path' THEN 'storage_path'
        WHEN 'config_root_parent' THEN '.codex:root_parent' ELSE CASE WHEN path LIKE '/home/%' THEN '.claude:root_in_home_directory|'
        WHEN path LIKE '%/.trae/%' THEN '.trae/cli:root_in_generic_directory|no_project_evidence' ELSE '' END || CASE WHEN path LIKE '%/.trae/%' THEN '' ELSE 'no_project_evidence' END END AS reasons FROM ob""",
    "current_by_tool": f"""SELECT tool, (SELECT count(*) FROM pr WHERE pr.tool = t.tool) AS pid_concurrency, (SELECT count(*) FROM ob WHERE ob.tool = t.tool) AS session_concurrency,
        (SELECT count(*) FROM ob WHERE ob.tool = t.tool AND {NOW} - last_us <= {GAP}) AS active_burst_concurrency FROM (VALUES ('claude'), ('codex'), ('trae')) t(tool)""",
    "current_metrics": f"SELECT (SELECT count(*) FROM pr) AS pid_concurrency, count(*) AS session_concurrency, count(*) FILTER ({NOW} - last_us <= {GAP}) AS active_burst_concurrency FROM ob",
    "snapshot_summary": """SELECT *, mapped_processes * 1000.0::DOUBLE / (mapped_processes + unmapped_processes) / 10 AS mapping_coverage_pct FROM (SELECT (SELECT count(*) FROM px) AS mapped_processes, (SELECT count(*) FROM pr) - (SELECT count(*) FROM px) AS unmapped_processes, 0::BIGINT AS multi_mapped_processes,
        count(*) FILTER (freshness = 'active') AS active_sessions, count(*) FILTER (freshness <> 'active') AS idle_sessions, count(*) FILTER (role = 'main') AS main_agent_sessions, count(*) FILTER (role = 'subagent') AS subagent_sessions,
        count(*) FILTER (role = 'unknown') AS unknown_role_sessions, count(DISTINCT project) AS project_count, count(DISTINCT project) FILTER (freshness = 'active') AS hot_project_count FROM ob)""",
    "age_buckets": """SELECT label, (SELECT count(*) FROM ob WHERE CASE WHEN last_us IS NULL THEN 'No trace' WHEN age_us <= 30000000 THEN '0-30s' WHEN age_us <= 7200000000 THEN '31-7200s' ELSE '5m+' END = label) AS sessions
        FROM (VALUES ('0-30s'), ('31-7200s'), ('7201-300s'), ('5m+'), ('No trace')) l(label)""",
    "project_focus": f"""SELECT project, session_count, active_burst_count, main_agent_sessions, subagent_sessions, unknown_role_sessions, stale_session_count, recent_session_count, process_count, basis, share AS attention_share_pct, age_s,
        CASE session_count WHEN ch THEN 'high' WHEN cl THEN 'low' ELSE 'medium' END AS confidence, CASE session_count WHEN sh THEN 'high' WHEN sr + su THEN 'low' ELSE 'medium' END AS attribution_confidence,
        array_to_string(list_filter([CASE WHEN cl > 0 THEN 'low_confidence:' || cl END, CASE WHEN miss > 0 THEN 'no_event_times:' || miss END,
        CASE WHEN ch > 0 AND cm + cl > 0 THEN 'mixed_confidence' END], lambda x: x IS NOT NULL), '|') AS confidence_reasons, {reasons()} AS attribution_reasons FROM focus2""",
    "project_tools": """SELECT *, row_number() OVER (PARTITION BY project ORDER BY active_burst_count DESC, session_count DESC, tool)::INT AS place FROM (SELECT project, tool, count(*) AS session_count, count(*) FILTER (freshness = 'active') AS active_burst_count,
        (SELECT count(DISTINCT pid) FROM pids p WHERE p.project = ob.project AND p.tool = ob.tool) AS process_count FROM ob GROUP BY project, tool)""",
    "attention_basis": "SELECT * FROM den",
    "candidate_workitems": f"""SELECT 'project=' || project || '|tool=' || tool || '|freshness=' || freshness AS key, project, tool, freshness, session_count, process_count, confidence, session_ids,
        array_to_string(list_filter(['by_project_tool_freshness', CASE WHEN session_count > 1 THEN 'sessions:' || session_count END,
        CASE WHEN low > 0 THEN 'low_confidence:' || low END, CASE WHEN miss > 0 THEN 'no_event_times:' || miss END], lambda x: x IS NOT NULL), '|') AS reasons, {reasons()} AS attribution_reasons FROM work""",
    "confidence_breakdown": "SELECT confidence AS level, count(*) AS n FROM ob GROUP BY 1",
    "provenance_summary": "SELECT level, count(*) AS n FROM (SELECT unnest(provenance) AS level FROM ob) GROUP BY 1",
    "attribution_sources": "SELECT source AS level, count(*) AS n FROM ob GROUP BY 1",
    "top_project": """SELECT (SELECT count(*) FROM own WHERE active_burst_count > 0) AS active_projects, (SELECT count(*) FROM own WHERE recent_session_count > 0) AS recent_projects, (SELECT count(*) FROM own) AS projects,
        project AS top_project, w * 100.0::DOUBLE / (SELECT sum(w) FROM own) AS top_share_pct FROM own ORDER BY w DESC, active_burst_count DESC, session_count DESC, process_count DESC, project LIMIT 1""",
    "duplicate_overlap": """SELECT coalesce(sum(n - 1), 0)::BIGINT AS suspicion, count(*) AS clusters, array_to_string(list_concat(list(project || '/' || tool || ' ' || freshness || ' x' || n ORDER BY r) FILTER (r <= 3),
        CASE WHEN count(*) > 3 THEN ['+' || (count(*) - 3) || ' more'] ELSE [] END), '; ') AS details FROM (SELECT *, row_number() OVER (ORDER BY n DESC, freshness, project, tool) AS r FROM (
        SELECT project, tool, freshness, count(*) AS n FROM ob WHERE project <> 'unassigned' AND freshness IN ('active', 'idle') GROUP BY ALL HAVING count(*) > 1))""",
    "workitem_coverage": """SELECT count(*) AS workitems, coalesce(sum(session_count) FILTER (project <> 'unassigned'), 0)::BIGINT AS covered, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium,
        count(*) FILTER (confidence = 'low') AS low, sum(session_count)::BIGINT AS sessions, coalesce(sum(session_count) FILTER (project <> 'unassigned'), 0) * 1000.0::DOUBLE / sum(session_count) / 10 AS coverage_pct FROM work""",
    "load_peak": f"""SELECT value, source FROM (SELECT count(*) AS value, 'current_snapshot' AS source, 0 AS o FROM ob UNION ALL SELECT peak, 'today_transcript_peak', 1 FROM ({peak('spans', f'({NOW} - {NOW} % {DAY})', str(NOW))})
        UNION ALL SELECT peak, 'seven_day_transcript_peak', 2 FROM ({peak('spans', f'({NOW} - 7 * {DAY})', str(NOW))})) ORDER BY value DESC, o LIMIT 1""",
    "snapshot_notes": """SELECT unnest(list_filter([CASE WHEN a > 0 THEN 'processes_without_session:' || a END, CASE WHEN b > 0 THEN 'sessions_without_times:' || b END,
        CASE WHEN c > 0 THEN 'sessions_without_process:' || c END,
        'files_deferred:3'], lambda x: x IS NOT NULL)) AS note
        FROM (SELECT (SELECT count(*) FROM pr WHERE k = 4) AS a, (SELECT count(*) FROM ob WHERE missing) AS b, (SELECT count(*) FROM alone) AS c)""",
    "history_load_stats": f"""SELECT count(*) FILTER (hour % 50 <> 0) AS loaded, count(*) FILTER (hour % 50 <> 0 AND hour * {HOUR} < {NOW} - 30 * {DAY}) AS dropped, count(*) FILTER (hour % 50 = 0) AS corrupt,
        (SELECT count(*) FROM samples) AS retained, (SELECT min(at_us) FROM samples) AS first_us, (SELECT max(at_us) FROM samples) AS last_us FROM hist""",
    "history_dedup": "SELECT at_us, pid_concurrency, session_concurrency, active_burst_concurrency, mapped_processes, unmapped_processes FROM samples",
    "history_trend_points": "SELECT at_us, pid_concurrency, session_concurrency FROM samples",
    "confidence_grid": "SELECT c AS confidence, (SELECT count(*) FROM ob WHERE ob.confidence = c) AS n FROM (SELECT unnest(['high', 'medium', 'low']) AS c)",
    "history_range": f"SELECT at_us, pid_concurrency FROM samples WHERE at_us BETWEEN {NOW} - 3 * {DAY} AND {NOW} - {DAY}",
    "history_allocation": f"""SELECT project, count(*) AS samples, round(sum(share) / count(*), 6) AS average_share_pct, max(share) AS peak_share_pct, max(s) AS max_sessions, max(n) AS max_active_bursts, max(n) AS max_processes FROM (
        SELECT ts_us // {HOUR} AS hour, 'p' || user_id % 7 AS project, count(*) AS n, count(DISTINCT session_id) AS s, count(*) * 1000.0::DOUBLE / any_value(total) / 10 AS share FROM ev
        JOIN (SELECT ts_us // {HOUR} AS h, count(*) AS total FROM ev GROUP BY 1) ON h = ts_us // {HOUR} WHERE user_id % 11 <> 0 GROUP BY ALL) JOIN samples USING (hour) WHERE at_us BETWEEN {NOW} - 7 * {DAY} AND {NOW} GROUP BY project""",
    "history_growth": "SELECT count(*) AS samples, min(at_us) AS from_us, max(at_us) AS to_us, " + ", ".join(f"min_by({c}, at_us) AS {c}_start, max_by({c}, at_us) AS {c}_end, max_by({c}, at_us) - min_by({c}, at_us) AS {c}_delta" for c in ("pid_concurrency", "session_concurrency", "active_burst_concurrency")) + f" FROM samples WHERE at_us BETWEEN {NOW} - 7 * {DAY} AND {NOW}",
    "history_peaks": " UNION ALL ".join(f"SELECT '{c}' AS metric, max({c}) AS value, min_by(at_us, (-{c}, at_us)) AS at_us FROM samples" for c in ("pid_concurrency", "session_concurrency", "active_burst_concurrency", "mapped_processes", "unmapped_processes")),
    "redact_text": r"""SELECT page_id, text FROM (WITH texts AS (SELECT page_id, 'see file:///var/data/p' || page_id || '/x.html, cwd:/srv/w' || page_id % 7 || ' or (/tmp/) from ' || url || ' ' || html AS text FROM pages),
        tokens AS (SELECT page_id, text, unnest(range(len(f))) AS i, unnest(f) AS token FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS f FROM texts)),
        parts AS (SELECT *, regexp_extract(token, '^(["''(\[{<]*)((?s:.)*?)(["'')\]}>,;:]*)$', ['lead', 'core', 'tail']) AS p FROM tokens),
        keyed AS (SELECT *, CASE WHEN contains(p.core, '=') THEN regexp_extract(p.core, '^[^=]*=') WHEN regexp_matches(p.core, '^[^:]+:(?s:.)') THEN regexp_extract(p.core, '^[^:]+:') ELSE '' END AS key FROM parts),
        plain AS (SELECT *, substr(p.core, length(key) + 1) AS value, regexp_replace(substr(p.core, length(key) + 1), '(?i)^file:(//[^/]*)?/', '/') AS bare FROM keyed),
        done AS (SELECT *, p.lead || key || CASE WHEN bare NOT LIKE '/%' THEN value ELSE coalesce(nullif(list_filter(string_split(bare, '/'), lambda x: x NOT IN ('', '.'))[-1], ''), 'local-path') END || p.tail AS said FROM plain)
        SELECT page_id, CASE WHEN bool_and(said = token) THEN any_value(text) ELSE string_agg(said, ' ' ORDER BY i) END AS text FROM done GROUP BY page_id)""",
    "redact_command": "SELECT pid, tool || ' --session-id=<value> --cwd=<value> -v resume ...' AS command FROM pr",
    "session_tree": "SELECT tool, count(*) FILTER (place = 'main') AS mains, count(*) FILTER (place = 'child') AS children, count(*) FILTER (place = 'unlinked') AS unlinked, count(*) FILTER (place = 'unknown') AS unknown FROM tree GROUP BY tool",
    "session_tree_hidden": """SELECT t.tool, (coalesce((SELECT sum(CASE WHEN nth > 3 THEN kids + 1 ELSE greatest(0, kids - 1) END) FROM branches b WHERE b.tool = t.tool), 0) + u - least(u, 2) + greatest(0, n - greatest(1, 2 - least(u, 2))))::BIGINT AS hidden
        FROM (SELECT tool, count(*) FILTER (place = 'unlinked') AS u, count(*) FILTER (place = 'unknown') AS n FROM tree GROUP BY tool) t""",
    "config_roots": """SELECT 'codex' AS tool, '/srv/known/.codex' AS root UNION SELECT '', '/srv/' || event_id || '/.codex' FROM ev WHERE event_id % 8 = 4 UNION SELECT 'trae', '/home/u/.trae/cli' FROM ev WHERE event_id % 8 = 3
        UNION SELECT '', unnest(['/srv/a/.codex', '/home/b/.claude']) FROM ev WHERE event_id % 8 = 7
        UNION SELECT 'codex', '/srv/x/.codex' FROM pr WHERE k = 1 OR (k = 0 AND user_id % 10 = 0)
        UNION SELECT tool, CASE tool WHEN 'claude' THEN '/home/u' || user_id || '/.claude' WHEN 'codex' THEN '/srv/p' || user_id % 7 || '/.codex' ELSE '/srv/p' || user_id % 7 || '/.trae/cli' END FROM pr WHERE k IN (0, 3)""",
    "host_ancestor": """SELECT start AS pid, pid AS host_pid, '/Applications/Term' || (pid - 2) || '.app' AS bundle FROM climb WHERE (pid - 2) % 9 = 4""",
    "coordination_risk": """SELECT 'observed' AS posture, 60 AS recent_window_minutes, s.*, (SELECT count(*) FROM pr WHERE k = 4) AS orphan_processes, (SELECT count(*) FROM own WHERE active_burst_count > 0) AS active_projects,
        (SELECT count(*) FROM own WHERE recent_session_count > 0) AS recent_projects, (SELECT count(*) FROM own) AS projects, top.project AS top_project, top.w * 100.0::DOUBLE / (SELECT sum(w) FROM own) AS top_share_pct,
        (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM dup) AS suspicion, (SELECT count(*) FROM dup) AS clusters, w.*, lp.peak_value, lp.peak_source,
        CASE WHEN (SELECT count(*) FROM own) > 1 AND anchored_sessions > 1 THEN (SELECT count(*) FROM own) * 1000.0::DOUBLE / anchored_sessions / 10 ELSE 0 END AS fragmentation_pct, sessions * 1000.0::DOUBLE / peak_value / 10 AS load_ratio_pct
        FROM (SELECT count(*) AS sessions, count(*) FILTER (freshness = 'stale') AS stale_sessions, count(*) FILTER (confidence = 'low') AS low_sessions, count(*) FILTER (missing) AS missing_sessions,
          count(*) FILTER (confidence = 'low' OR missing) AS low_confidence_sessions, count(*) FILTER (recent) AS churn_sessions, count(*) FILTER (project <> 'unassigned') AS anchored_sessions FROM ob) s,
        (SELECT * FROM own ORDER BY w DESC, active_burst_count DESC, session_count DESC, process_count DESC, project LIMIT 1) top,
        (SELECT count(*) AS workitems, coalesce(sum(session_count) FILTER (project <> 'unassigned'), 0)::BIGINT AS covered, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
          coalesce(sum(session_count) FILTER (project <> 'unassigned'), 0) * 1000.0::DOUBLE / sum(session_count) / 10 AS coverage_pct FROM work) w,
        (SELECT value AS peak_value, source AS peak_source FROM (PEAKS)) lp""",
    "redact_sessions": None,
    "entity_search": "SELECT 'project' AS kind, 'p3' AS id FROM (SELECT 1 FROM ob WHERE project = 'p3' LIMIT 1) UNION ALL SELECT 'session', tool || '/' || session_id FROM ob WHERE project = 'p3' UNION ALL SELECT 'process', pid::VARCHAR FROM pr WHERE user_id % 7 = 3",
    "project_sessions": "SELECT key, freshness FROM ob WHERE project = 'p3'",
    "role_matrix": "SELECT project, count(*) FILTER (role = 'main') AS main, count(*) FILTER (role = 'subagent') AS subagent, count(*) FILTER (role = 'unknown') AS unknown, count(*) FILTER (role = 'main' AND freshness = 'active') AS active_main, count(*) FILTER (role = 'subagent' AND freshness = 'active') AS active_subagent, count(*) FILTER (role = 'unknown' AND freshness = 'active') AS active_unknown, count(*) AS total, count(*) FILTER (freshness = 'active') AS active_total FROM ob GROUP BY 1",
    "tool_mix": "SELECT tool, count(*) AS sessions, count(*) FILTER (freshness = 'active') AS active FROM ob GROUP BY 1 ORDER BY sessions DESC, tool LIMIT 4",
    "projects_by_attention": "SELECT project, active_burst_count, share AS attention_share_pct, row_number() OVER (ORDER BY active_burst_count DESC, share DESC, project)::INT AS place FROM focus2",
    "calibration": f"""SELECT key, value, value * 100.0::DOUBLE / greatest(1, max(value) OVER ()) AS pct FROM (SELECT 'burst' AS key, count(*) FILTER ({NOW} - last_us <= {GAP}) AS value FROM ob UNION ALL SELECT 'session', count(*) FROM ob UNION ALL SELECT 'pid', count(*) FROM pr)""",
    "refresh_slot": "SELECT event_id, '300s:' || strftime(make_timestamp(ts_us - ts_us % 300000000), '%Y-%m-%dT%H:%M:%SZ') AS slot, '700s:' || strftime(make_timestamp(ts_us - (ts_us + 62135596800000000) % 700000000), '%Y-%m-%dT%H:%M:%SZ') AS odd_slot FROM ev",
    "refresh_slot_dedup": "SELECT '3600s:' || strftime(make_timestamp(ts_us - ts_us % 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS slot, min(ts_us) AS first_us FROM ev GROUP BY 1",
    "duration_label": """SELECT tool, session_id, CASE WHEN s = 0 THEN '0s' WHEN s % 3600 = 0 THEN s // 3600 || 'h' WHEN s % 60 = 0 THEN s // 60 || 'm' ELSE s || 's' END AS label
        FROM (SELECT tool, session_id, (end_us - start_us) // 1000000 AS s FROM spans)""",
}
OWN = BASE.rstrip() + ", own AS (SELECT *, (CASE WHEN basis = 'process_count' AND process_count > 0 THEN process_count WHEN basis = 'session_count' AND session_count > 0 THEN session_count WHEN share > 0 THEN share ELSE session_count END)::DOUBLE AS w FROM focus2 WHERE project <> 'unassigned')\n"
TREE = f"""{OWN.rstrip()}, dup AS (SELECT project, tool, freshness, count(*) AS n FROM ob WHERE project <> 'unassigned' AND freshness IN ('active', 'idle') GROUP BY ALL HAVING count(*) > 1),
rank AS (SELECT *, CASE freshness WHEN 'active' THEN 0 WHEN 'idle' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END AS r, CASE WHEN u % 10 > 6 THEN 'u' || (u - u % 10) END AS parent FROM ob),
tree AS (SELECT c.key, c.r, c.age_s, CASE WHEN c.role = 'main' THEN 'main' WHEN c.role = 'subagent' AND p.role = 'main' THEN 'child' WHEN c.role = 'subagent' THEN 'unlinked' ELSE 'unknown' END AS place,
    CASE WHEN c.role = 'subagent' AND p.role = 'main' THEN p.tool ELSE c.tool END AS tool, CASE WHEN c.role = 'subagent' AND p.role = 'main' THEN p.key END AS parent_key FROM rank c LEFT JOIN (
    SELECT * FROM rank WHERE session_id <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY r DESC, age_s DESC NULLS LAST, key DESC) = 1) p ON c.parent = p.session_id),
branches AS (SELECT m.tool, row_number() OVER (PARTITION BY m.tool ORDER BY r, age_s NULLS LAST, m.key) AS nth, (SELECT count(*) FROM tree c WHERE c.parent_key = m.key) AS kids FROM tree m WHERE place = 'main')
"""
CLIMB = BASE.replace("WITH ev", "WITH RECURSIVE ev").rstrip() + """, climb AS (SELECT user_id + 2 AS start, user_id + 2 AS pid, 1 AS n, [user_id + 2] AS seen FROM (SELECT DISTINCT user_id FROM ev)
    UNION ALL SELECT start, u.user_id + 2, n + 1, list_append(seen, u.user_id + 2) FROM climb c JOIN (SELECT DISTINCT user_id FROM ev) u
    ON u.user_id + 2 = CASE WHEN (c.pid - 2) % 50 = 7 THEN c.pid ELSE (c.pid - 2) // 2 + 1 END WHERE (c.pid - 2) % 9 <> 4 AND n < 12 AND NOT list_contains(seen, u.user_id + 2))
"""
HEADS = {"top_project": OWN, "coordination_risk": TREE, "risk_signals": TREE, "session_tree": TREE, "session_tree_hidden": TREE, "host_ancestor": CLIMB}
SQL["coordination_risk"] = SQL["coordination_risk"].replace("PEAKS", SQL["load_peak"])
#: Every line of every file, with its bytes.
LINES = """lines AS (SELECT session_id, event_id, ts_us, octet_length(encode('{"type":"' || kind || '","timestamp":"' || CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') END || '"'
  || CASE WHEN event_id % 3 = 0 THEN ',"sessionId":"' || session_id || '"' ELSE '' END || CASE WHEN event_id % 4 = 1 THEN ',"payload":{"cwd":"/srv/w' || event_id % 5 || '"}' ELSE '' END
  || CASE WHEN event_id % 7 = 2 THEN ',"project":"q' || event_id % 3 || '"' ELSE '' END || CASE WHEN event_id % 10 = 3 THEN ',"thread_source":"' || CASE WHEN event_id % 20 = 3 THEN 'Human' ELSE 'agent' END || '"' ELSE '' END
  || CASE WHEN event_id % 25 = 4 THEN ',"parent_thread_id":"u' || event_id % 6 || '"' ELSE '' END || '}')) + 1 AS bytes FROM ev)"""
SQL["transcript_tails"] = f""", {LINES}, placed AS (SELECT *, sum(bytes) OVER (PARTITION BY session_id ORDER BY event_id DESC) AS from_end, sum(bytes) OVER (PARTITION BY session_id) AS size FROM lines)
SELECT session_id AS session, any_value(size)::BIGINT AS size, coalesce(arg_max(ts_us, event_id) FILTER (event_id % 9 <> 0 AND (size <= 2048 OR from_end < 2048)) >= {NOW} - 6 * {HOUR}, true) AS may_hold FROM placed GROUP BY session_id"""
SQL["trace_fold"] = """SELECT path, tool, coalesce(arg_max(sid, event_id), any_value(session_id)) AS session_id, arg_max(src, event_id) AS thread_source, arg_max(parent, event_id) AS parent_thread_id,
    arg_min(CASE WHEN src IS NOT NULL THEN 'thread_source' WHEN parent IS NOT NULL THEN 'parent_thread_id' END, event_id) AS role_hint_source,
    bool_and(coalesce(src, '') <> 'subagent' AND parent IS NULL) AS independently_run, count(DISTINCT seen_us) AS events, min(seen_us) AS first_us, max(seen_us) AS last_us,
    coalesce(arg_max(named, event_id), arg_max(cwd, event_id), arg_max(stored, event_id)) AS project,
    CASE WHEN count(named) > 0 THEN 'transcript_project' WHEN count(cwd) > 0 THEN 'transcript_cwd' WHEN count(stored) > 0 THEN 'transcript_path' END AS project_source
    FROM (SELECT path, tool, event_id, session_id, ts_us AS seen_us, CASE WHEN event_id % 3 = 0 THEN session_id END AS sid,
        CASE WHEN tool = 'claude' THEN NULL WHEN event_id % 20 = 3 THEN 'user' WHEN event_id % 10 = 3 THEN 'subagent' END AS src, CASE WHEN tool <> 'claude' AND event_id % 25 = 4 THEN 'u' || event_id % 6 END AS parent,
        CASE WHEN event_id % 7 = 2 THEN 'q' || event_id % 3 END AS named, CASE WHEN event_id % 4 = 1 THEN 'w' || event_id % 5 END AS cwd,
        CASE WHEN tool = 'claude' THEN 'p' || user_id % 7 END AS stored FROM ev WHERE event_id % 9 > 0)
    GROUP BY path, tool HAVING count(seen_us) > 0"""
SIGNALS = (
    ("top_project_share", "top_project <> ''", "top_project", "CASE WHEN active_projects > 1 THEN active_projects - 1 WHEN recent_projects > 1 THEN recent_projects - 1 WHEN projects > 1 THEN projects - 1 ELSE 0 END", "NULL", "top_share_pct"),
    ("sessions_without_recent_event", "stale_sessions > 0", "'6h'", "stale_sessions", "NULL", "NULL"),
    ("unmatched_processes", "orphan_processes > 0", "NULL", "orphan_processes", "NULL", "NULL"),
    ("recent_sessions", "churn_sessions > 0", "recent_window_minutes || 'm'", "churn_sessions", "NULL", "NULL"),
    ("project_spread", "projects > 1 AND anchored_sessions > 1", "NULL", "anchored_sessions", "projects", "fragmentation_pct"),
    ("observed_peak_ratio", "peak_value > 0 AND sessions > 0", "peak_source", "sessions", "peak_value", "load_ratio_pct"),
    ("duplicate_overlap_candidates", "suspicion > 0 OR clusters > 0", "(SELECT details FROM (DETAILS))", "suspicion", "clusters", "NULL"),
    ("low_confidence_mapping", "low_confidence_sessions > 0", "'low:' || low_sessions || ',no_event_times:' || missing_sessions", "low_confidence_sessions", "NULL", "NULL"),
    ("candidate_workitem_coverage", "sessions > 0", "concat_ws(',', CASE WHEN high > 0 THEN 'high:' || high END, CASE WHEN medium > 0 THEN 'medium:' || medium END, CASE WHEN low > 0 THEN 'low:' || low END)", "covered", "sessions", "coverage_pct"),
)
SQL["trace_state"] = SQL["trace_fold"]
SQL["late_bursts"] = SQL["burst_spans"]
SQL["history_whole"] = f"""SELECT hour * {HOUR} AS at_us, n AS pid_concurrency, u AS session_concurrency, 0::BIGINT AS active_burst_concurrency, u AS active_sessions, n / 4.0::DOUBLE AS mapping_coverage_pct,
    p AS top_project, n % 7 AS stale_session_count, CASE WHEN n % 2 = 0 THEN 'transcript_burst' ELSE '' END AS load_peak_source, 0.0::DOUBLE AS fragmentation_pct, u % 3 AS main_agent_sessions
    FROM (SELECT ts_us // {HOUR} AS hour, count(*) AS n, count(DISTINCT session_id) AS u, coalesce(min('p' || user_id % 7) FILTER (user_id % 11 <> 0), '') AS p, max(max(ts_us // {HOUR})) OVER () AS newest FROM ev GROUP BY 1)
    WHERE hour >= newest - 720"""
SQL["redact_tables"] = f"""SELECT c.pid, c.command, 0 AS paths, tool AS name, '' AS bundle_path, 'project=p' || c.pid % 7 || '|tool=' || tool AS key,
    'p' || c.pid % 7 AS project, 'seen in (s.jsonl), twice; by id' AS reasons FROM pr JOIN ({SQL["redact_command"]}) c ON c.pid = pr.pid"""
SQL["config_roots_found"] = f"SELECT tool, root FROM ({SQL['config_roots']}) r WHERE EXISTS (SELECT 1 FROM ev WHERE starts_with(ev.path, r.root || '/'))"
SQL["risk_signals"] = "SELECT place, kind, subject, n, of_n, pct FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INT AS place, '{kind}' AS kind, ({subject})::VARCHAR AS subject, ({n})::BIGINT AS n, ({of_n})::BIGINT AS of_n, ({pct})::DOUBLE AS pct FROM ({SQL['coordination_risk']}) WHERE {when}"
    for i, (kind, when, subject, n, of_n, pct) in enumerate(SIGNALS)
).replace("DETAILS", SQL["duplicate_overlap"]) + ")"
SQL["redact_sessions"] = f"SELECT b.tool, b.session_id, a.project, b.freshness, b.confidence, a.reasons, 'project=' || a.project || '|tool=' || b.tool || '|freshness=' || b.freshness AS key FROM ({SQL['project_attribution']}) a JOIN ob b USING (key)"
ORACLES = {name: HEADS.get(name, BASE) + sql for name, sql in SQL.items()}
