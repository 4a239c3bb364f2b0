from sessionloom.operators import redaction


def test_snapshot_tables(spark):
    frame = spark.sql(r"""
        select named_struct('claude_roots', array('/home/me/.claude'), 'history_file', '/home/me/h.jsonl', 'days', 7) as config,
          named_struct('store_path', '/x/y', 'samples', 3) as history, array('see /srv/demo/a.txt', 'plain') as notes,
          named_struct('top_project', ' /srv/demo ', 'signals', array(named_struct('kind', 'k', 'evidence', 'cwd:/srv/demo 3 of 4'), named_struct('kind', 'l', 'evidence', cast(null as string)))) as coordination_risk,
          array(named_struct('project', '/srv/alpha', 'confidence_reasons', array('from file:///srv/alpha/s.jsonl'), 'tools', array('codex'))) as project_focus,
          array(named_struct('key', 'project=/srv/alpha|tool=codex|freshness=active', 'project', 'beta', 'session_ids', array('/keep/this'))) as candidate_workitems,
          array(named_struct('pid', 1, 'command', '/opt/bin/codex --cwd=/w resume x', 'session_paths', array('/a/b'), 'host_app', named_struct('name', 'Term', 'bundle_path', '/Applications/Term.app')),
                named_struct('pid', 2, 'command', '', 'session_paths', cast(null as array<string>), 'host_app', null)) as live_processes,
          array(named_struct('path', '/a/s.jsonl', 'role_reasons', array('in (/tmp/x/)'), 'host_apps', array(named_struct('name', 'T', 'bundle_path', '/A.app')))) as live_sessions""")
    out = redaction.redacted(frame)
    assert out.schema.simpleString() == frame.schema.simpleString()
    r = out.first()
    assert (r.config.claude_roots, r.config.history_file, r.config.days, r.history.store_path, r.history.samples) == ([], "", 7, "", 3)
    assert r.notes == ["see a.txt", "plain"] and r.coordination_risk.top_project == "demo"
    assert [s.evidence for s in r.coordination_risk.signals] == ["cwd:demo 3 of 4", None] and r.coordination_risk.signals[0].kind == "k"
    assert r.project_focus[0].project == "alpha" and r.project_focus[0].confidence_reasons == ["from file:s.jsonl"] and r.project_focus[0].tools == ["codex"]
    w = r.candidate_workitems[0]
    assert (w.key, w.project, w.session_ids) == ("project=alpha|tool=codex|freshness=active", "beta", ["/keep/this"])
    one, two = r.live_processes
    assert (one.command, one.session_paths, one.host_app.name, one.host_app.bundle_path) == ("codex --cwd=<value> resume ...", [], "Term", "")
    assert (two.command, two.session_paths, two.host_app) == ("", None, None)
    s = r.live_sessions[0]
    assert (s.path, s.role_reasons, s.host_apps[0].bundle_path) == ("", ["in (x)"], "")
    assert redaction.redacted(frame.limit(0)).count() == 0


def test_keys_and_own_rules(spark):
    frame = spark.createDataFrame([("project=|tool=a=b|project=/x/y/|other",), ("",), (None,), ("noequals",)], "key string")
    assert [r["key"] for r in redaction.redacted(frame).collect()] == ["project=|tool=a=b|project=y|other", "", None, "noequals"]
    assert redaction.redacted(frame, {"key": redaction.blank}).where("key = ''").count() == 3
