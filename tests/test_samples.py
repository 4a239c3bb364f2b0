import json
import os

from sessionloom.operators import samples

DAY = 86_400_000_000
T0 = 1_782_561_600_000_000


def snapshots(spark, rows):
    """(at_us, n) as snapshots with all parts and some more."""
    frame = spark.createDataFrame(rows, "at_us long, n long")
    return frame.selectExpr(
        "at_us", "named_struct('pid_concurrency', n, 'session_concurrency', n + 1, 'active_burst_concurrency', 0L, 'beyond', 'x') as current",
        "named_struct('active_sessions', n, 'mapping_coverage_pct', n / 4) as summary",
        "named_struct('posture', 'calm', 'top_project', 'p' || n, 'load_peak_value', n, 'load_peak_source', if(n % 2 = 0, '', 'peak'), 'fragmentation_pct', 12.5D) as coordination_risk",
        "if(n = 3, null, array(named_struct('project', 'a', 'session_count', n, 'main_agent_sessions', n - 1, 'attention_share_pct', 50.0D), named_struct('project', 'b', 'session_count', 0L, 'main_agent_sessions', 0L, 'attention_share_pct', 0D))) as projects",
        "'more' as notes",
    )


def test_round_trip_of_all_fields(spark):
    frame = snapshots(spark, [(T0 + i, i) for i in range(6)])
    want = {r.at_us: r for r in samples.projected(frame).collect()}
    lines = samples.to_lines(frame)
    found = samples.from_lines(lines).collect()
    assert len(found) == 6 and all(want[r.at_us] == r for r in found)
    one = json.loads(lines.where("value like '%p2%'").first().value)
    assert set(one) == {"at", "current", "summary", "coordination_risk", "projects"} and "load_peak_source" not in one["coordination_risk"]
    assert set(one["projects"][1]) == {"project", "session_count", "active_burst_count", "process_count", "attention_share_pct"} and one["projects"][0]["main_agent_sessions"] == 1
    assert one["summary"]["hot_project_count"] == 0 and one["coordination_risk"]["top_project"] == "p2"


def test_old_broken_and_new_lines_in_one_table(spark):
    old = {"at": "2026-06-27T12:00:00Z", "current": {"pid_concurrency": 4}, "summary": {"mapped_processes": 2}, "projects": [{"project": "a", "session_count": 1}]}
    lines = [json.dumps(old), "{", '{"at":"yesterday"}', '{"at":"2026-06-28T12:00:00Z","unknown":[1]}', ""]
    found = samples.from_lines(spark.createDataFrame([(x,) for x in lines], "value string").union(samples.to_lines(snapshots(spark, [(T0, 5)])).select("value"))).orderBy("at_us", "current.pid_concurrency").collect()
    assert [r.current.pid_concurrency for r in found] == [4, 5, 0]
    assert found[0].coordination_risk.posture == "" and found[0].projects[0].subagent_sessions == 0 and found[2].projects == [] and found[1].coordination_risk.load_peak_source == "peak"


def test_store_with_retention(spark, tmp_path):
    root = str(tmp_path)
    kept = lambda: sorted((r.at_us, r.current.pid_concurrency) for r in samples.stored(spark, root).collect())
    land = lambda number, *rows: samples.land_batch(snapshots(spark, list(rows)), root, number)
    land(0, (T0 - 31 * DAY, 1), (T0 - 29 * DAY, 2), (T0, 3))
    first = [(T0 - 29 * DAY, 2), (T0, 3)]
    assert kept() == first and samples.compact(spark, root) == 1 and kept() == first
    land(0, (T0, 99))  # a batch that is in already changes nothing
    assert kept() == first and samples.compact(spark, root) == 1
    land(1, (T0, 4), (T0 + 1, 5))
    land(1, (T0, 4), (T0 + 2, 6))  # repeated: its own rows go
    land(2, (T0 + DAY, 7))
    second = [(T0 - 29 * DAY, 2), (T0, 4), (T0 + 2, 6), (T0 + DAY, 7)]
    assert kept() == second
    os.makedirs(f"{root}/compacted/version=2/day=2026-06-27")  # a compaction that broke off
    (tmp_path / "compacted/version=2/day=2026-06-27/part-0.parquet").write_text("half")
    assert kept() == second
    assert samples.compact(spark, root) == 2 and kept() == second
    land(3, (T0 + 2 * DAY, 8))
    assert kept() == [*second[1:], (T0 + 2 * DAY, 8)]  # by the new sample's time
    assert samples.compact(spark, root) == 3
    assert spark.read.parquet(f"{root}/compacted/version=3").count() == 4


def test_streamed_samples(spark, tmp_path):
    for i in range(3):
        snapshots(spark, [(T0 + i, i)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(snapshots(spark, [(0, 0)]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    samples.keep_samples(stream, str(tmp_path / "store"), str(tmp_path / "c"), compact_every=2).awaitTermination()
    assert samples.manifest(spark, str(tmp_path / "store")) == (1, 1)
    assert samples.stored(spark, str(tmp_path / "store")).count() == 3
