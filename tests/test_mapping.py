from sessionloom.operators import history, indicators, mapping, rollups, traces

PROCESS = "pid long, tool string, command string, files array<struct<tool:string,path:string>>, hints array<string>"
TRACE = "path string, tool string, session_id string, project string, project_source string, thread_source string, parent_thread_id string, role_hint_source string, independently_run boolean, first_us long, last_us long"
T, R = "/w/.codex/sessions/trace.jsonl", "/w/.codex/sessions/rollout-2026-06-28T10-00-00-fallback-session.jsonl"
NOW, S = 1_782_561_600_000_000, 1_000_000


def trace(spark, *rows):
    return spark.createDataFrame([(p, "codex", i, None, None, src, None, None, False, NOW - 3600 * S, NOW - age * S) for p, i, src, age in rows], TRACE)


def process(spark, *rows):
    return spark.createDataFrame([(pid, "codex", "", [("codex", f) for f in files], list(hints)) for pid, files, hints in rows], PROCESS)


def flags(r):
    return "".join(n[0] if getattr(r, n) else "-" for n in ("parsed_transcript_id", "command_hint", "fallback_session_id"))


def test_three_processes_two_sessions(spark):
    t = trace(spark, (T, "trace-session", None, 30))
    p = process(spark, (101, [T], []), (102, [], ["trace-session"]), (103, [R], []))
    live = {r.session_id: r for r in mapping.live_sessions(mapping.process_sessions(p, t), t, NOW, 90).collect()}
    assert set(live) == {"trace-session", "fallback-session"}
    assert flags(live["trace-session"]) == "pc-" and live["trace-session"].pids == [101, 102]
    assert flags(live["fallback-session"]) == "--f" and live["fallback-session"].trace_path is None


def test_hint_and_file_name_agree(spark):
    found = mapping.process_sessions(process(spark, (1, [R], ["fallback-session"])), trace(spark)).collect()
    assert [(r.session_id, flags(r), r.transcript_path) for r in found] == [("fallback-session", "-cf", True)]


def test_parsed_id_beats_hint_and_drops_siblings(spark):
    t = trace(spark, (T, "trace-session", None, 30))
    p = process(spark, (1, [T, R], ["conflicting"]))
    assert [(r.session_id, flags(r)) for r in mapping.process_sessions(p, t).collect()] == [("trace-session", "p--")]
    assert "conflicting" in mapping.mapping_notes(p, t).first().note


def test_hint_beats_file_name(spark):
    p = process(spark, (1, [R], ["hint-session"]))
    assert [(r.session_id, flags(r)) for r in mapping.process_sessions(p, trace(spark)).collect()] == [("hint-session", "-c-")]
    assert "fallback-session" in mapping.mapping_notes(p, trace(spark)).first().note


def test_transcript_only_sessions_are_recent_ones(spark):
    t = trace(spark, (T, "new", "subagent", 30), (R, "old", None, 100_000))
    found = mapping.observe(mapping.live_sessions(mapping.process_sessions(process(spark), t), t, NOW, 90), NOW, 90).collect()
    assert [(r.session_id, r.freshness, r.role, r.role_confidence) for r in found] == [("new", "active", "subagent", "high")]


def test_rollups_of_nothing(spark):
    seen = mapping.observe(mapping.live_sessions(mapping.process_sessions(process(spark), trace(spark)), trace(spark), NOW, 90), NOW, 90)
    assert [r.sessions for r in rollups.age_buckets(seen, NOW, 90).collect()] == [0] * 5
    assert rollups.attention_basis(seen).first().basis == "session_count"
    assert indicators.duplicate_overlap(seen).first().suspicion == 0
    assert indicators.top_project(rollups.project_focus(seen, NOW)).first().top_project == ""


def test_host_ancestors_end_at_cycles(spark):
    p = spark.createDataFrame([(100, 1, "/Applications/Terminal.app/x"), (200, 100, "zsh"), (300, 301, "a"), (301, 300, "b")], "pid long, ppid long, command string")
    assert {(r.pid, r.host_pid) for r in mapping.host_ancestors(p).collect()} == {(100, 100), (200, 100)}


def test_last_project_of_strongest_source(spark):
    lines = ['{"timestamp":"2026-06-28T12:00:00Z","project":"first","sessionId":"a"}', '{"timestamp":"2026-06-28T12:01:00Z","cwd":"/w/dir"}', '{"timestamp":"2026-06-28T12:01:00Z","project":"second"}', '{"timestamp":"2026-06-28T12:01:00Z","payload":{"source":{"thread_spawn":{"parent_thread_id":"p"}}},"x":1}', '{"parent_thread_id":"of no time","project":"third","thread_source":"user"}', "not json"]
    rows = spark.createDataFrame([("/w/.codex/sessions/a.jsonl", "codex", i, v) for i, v in enumerate(lines)], "path string, tool string, line_no long, value string")
    r = traces.fold_traces(rows).first()
    assert (r.project, r.project_source, r.events, r.session_id, r.parent_thread_id, r.independently_run) == ("second", "transcript_project", 2, "a", "p", False)


def test_what_lines_of_each_tool_say(spark):
    stamp = '"timestamp":"2026-06-28T12:00:00Z"'
    lines = ["{%s,\"type\":\"user\",\"message\":{\"cwd\":\"/srv/inner\",\"project\":\"m\"},\"thread_source\":\"subagent\",\"parent_thread_id\":\"p\"}" % stamp, "{%s,\"x\":{\"payload\":{\"s\":\"}\",\"deep\":{\"sessionId\":\"inner\"}}},\"session_id\":\"outer\"}" % stamp]
    rows = [("/srv/x/.claude/projects/-a-b/own.jsonl", "claude", 0, lines[0]), ("/srv/x/.codex/sessions/a.jsonl", "codex", 0, lines[1]), ("/srv/x/.codex/sessions/named.jsonl", "codex", 0, "{%s}" % stamp), ("/srv/x/.codex/sessions/b.jsonl", "codex", 0, "{}")]
    found = {r.path.rpartition("/")[2]: r for r in traces.fold_traces(spark.createDataFrame(rows, "path string, tool string, line_no long, value string")).collect()}
    own = found["own.jsonl"]  # claude's lines say nothing of roles
    assert (own.session_id, own.project, own.project_source, own.thread_source, own.parent_thread_id, own.independently_run) == ("own", "m", "transcript_project", None, None, True)
    assert found["a.jsonl"].session_id == "inner" and found["named.jsonl"].session_id == "named" and set(found) == {"own.jsonl", "a.jsonl", "named.jsonl"}


def test_history_counts_broken_and_old_lines(spark):
    at = lambda d: f'{{"at":"2026-{d}T12:00:00Z","current":{{"pid_concurrency":4}},"projects":[{{"project":"a","attention_share_pct":60.0}}]}}'
    lines = [at("06-27"), at("06-27"), at("05-01"), "{", '{"at":"yesterday"}', "", at("06-26") + " x"]
    parsed = history.parse(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "line_no long, value string"))
    r = history.load_statistics(parsed, NOW).first()
    assert (r.loaded, r.dropped, r.corrupt, r.retained) == (3, 1, 3, 1)
    kept = history.retained(parsed, NOW)
    assert history.growth(kept).first().samples == 1 and history.allocation(kept).first().average_share_pct == 60
    assert history.in_range(kept, NOW, NOW - 1).count() == 0
    assert {x.metric: x.value for x in history.peaks(kept).collect()}["pid_concurrency"] == 4


def test_hosts_that_share_pids_and_paths_stay_apart(spark):
    """Two hosts with one pid, one path and one session id: two processes, two sessions, two ancestors."""
    kind = "host string, pid long, ppid long, tool string, command string, files array<struct<tool:string,path:string>>, hints array<string>"
    path = "/home/x/.codex/sessions/rollout-2024-01-01T00-00-00-a1.jsonl"
    processes = spark.createDataFrame([("h1", 7, 1, "codex", "/Applications/One.app/Contents/MacOS/one", [("codex", path)], []), ("h2", 7, 1, "codex", "codex", [("codex", path)], []), ("h2", 1, 0, "codex", "/Applications/Two.app/Contents/MacOS/two", [], ["b2"])], kind)
    traced = "host string, path string, tool string, session_id string, project string, project_source string, thread_source string, parent_thread_id string, role_hint_source string, independently_run boolean, first_us long, last_us long"
    traces = spark.createDataFrame([("h1", path, "codex", "one", "p", "transcript_project", None, None, None, True, 1, 1_000_000), ("h2", path, "codex", "two", "q", "transcript_project", None, None, None, True, 1, 2_000_000)], traced)
    sessions = mapping.process_sessions(processes, traces)
    assert {(r.host, r.pid, r.session_id) for r in sessions.collect()} == {("h1", 7, "one"), ("h2", 7, "two"), ("h2", 1, "b2")}
    assert {(r.host, r.pid): r.mapped_sessions for r in mapping.process_counts(processes, sessions).collect()} == {("h1", 7): 1, ("h2", 7): 1, ("h2", 1): 1}
    live = mapping.observe(mapping.live_sessions(sessions, traces, 2_000_000, 90), 2_000_000, 90)
    assert {(r.host, r.session_id, r.attributed) for r in live.collect()} == {("h1", "one", "p"), ("h2", "two", "q"), ("h2", "b2", "unassigned")}
    found = {(r.host, r.pid): r.host_pid for r in mapping.host_ancestors(processes).collect()}
    assert found == {("h1", 7): 7, ("h2", 7): 1, ("h2", 1): 1}
    assert rollups.attention_basis(live).first().denominator == 3


def test_roles_and_confidence_without_sessions_come_from_the_projects(spark):
    kind = "attributed string, role string, active_burst boolean, confidence string"
    focus = spark.createDataFrame([("p", 2, 1, 0, 1, 2, 1, 0)], "project string, main_agent_sessions long, subagent_sessions long, unknown_role_sessions long, active_burst_count long, c_high long, c_medium long, c_low long")
    none = spark.createDataFrame([], kind)
    r = rollups.role_matrix_or_projects(none, focus).first()
    assert (r.project, r.main, r.subagent, r.total, r.active_total) == ("p", 2, 1, 3, 1)
    some = spark.createDataFrame([("q", "main", True, "low")], kind)
    assert [r.project for r in rollups.role_matrix_or_projects(some, focus).collect()] == ["q"]
    assert {r.confidence: r.n for r in rollups.confidence_grid(focus, some).collect()} == {"high": 2, "medium": 1, "low": 0}
    assert {r.confidence: r.n for r in rollups.confidence_grid(focus.limit(0), some).collect()} == {"high": 0, "medium": 0, "low": 1}
