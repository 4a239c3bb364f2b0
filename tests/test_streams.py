import json

from pyspark.sql import functions as F

from sessionloom.operators import history, intervals, trends
from sessionloom.sources import transcripts
from sessionloom.streaming import jobs


def test_files_become_traces(spark, tmp_path):
    logs = tmp_path / "home/.codex/sessions"
    logs.mkdir(parents=True)
    (logs / "a.jsonl").write_text('{"timestamp":"2026-06-28T12:00:00Z","sessionId":"a"}\n\n  {"timestamp":"2026-06-28T12:05:00Z"}')
    (logs / "skip.txt").write_text("x\n")
    lines = transcripts.read_lines(spark, str(logs)).withColumn("tool", F.lit("codex"))
    assert lines.count() == 2
    cutoff = 1_782_561_600_000_000
    assert transcripts.may_hold_events_after(lines, cutoff).first().may_hold
    lines.select("path", "tool", "line_no", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, tool string, line_no long, value string").parquet(str(tmp_path / "in"))
    jobs.keep_traces(stream, str(tmp_path / "bronze"), str(tmp_path / "traces"), str(tmp_path / "c")).awaitTermination()
    r = jobs.latest_traces(spark, str(tmp_path / "traces")).first()
    assert (r.session_id, r.events) == ("a", 2)


def test_lane_sidecars(spark, tmp_path):
    lane = tmp_path / "alpha/.codex/.codexl/run1"
    lane.mkdir(parents=True)
    (lane / "events.jsonl").write_text('{"x":1}\n{"thread_id":"lane-1"}\n')
    (lane / "request.json").write_text(json.dumps({"request": {"requested_at": "2026-06-28T12:00:00Z"}}))
    (lane / "run.json").write_text(json.dumps({"run_id": "r", "started_at": "2026-06-28T12:01:00Z"}))
    root = str(tmp_path / "alpha/.codex/.codexl")
    found = transcripts.lane_traces(transcripts.lane_lines(spark, root), transcripts.sidecar(spark, root, "request.json"), transcripts.sidecar(spark, root, "run.json")).collect()
    assert len(found) == 3 and {(r.session_id, r.project, r.project_source) for r in found} == {("lane-1", "alpha", "config_root_parent")}


def test_streamed_bursts_are_the_batch_ones(spark, tmp_path):
    rows = [("a", t * 1_000_000) for t in (0, 10, 20, 180, 190)] + [("z", 10**13)]
    events = spark.createDataFrame(rows, "k string, ts_us long")
    events.select("k", F.timestamp_micros("ts_us").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "e"))
    q = jobs.streaming_bursts(stream, ["k"], "90 seconds", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.s, r.n) for r in spark.sql("select unix_micros(start_ts) s, events n from bursts").collect())
    batch = sorted((r.start_us, r.events) for r in intervals.burst_spans(events, ["k"], 90, 0).where("k = 'a'").collect())
    assert got == batch


def test_slots_and_history_streams(spark, tmp_path):
    spark.sql("select timestamp'2026-06-28 12:00:01' ts union all select timestamp'2026-06-28 12:00:05' union all select timestamp'2026-06-28 12:00:40'").write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "r"))
    q = jobs.slot_requests(stream, 30, "1 hour").writeStream.format("memory").queryName("slots").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("slots").count() == 2
    sample = spark.sql("select 1782561600000000L at_us, 1L pid_concurrency, 1L session_concurrency, 1L active_burst_concurrency, 1L mapped_processes, 0L unmapped_processes, array(named_struct('project', 'a')) projects")
    sample.write.parquet(str(tmp_path / "h"))
    snapshots = spark.readStream.schema(sample.schema).parquet(str(tmp_path / "h"))
    jobs.keep_history(snapshots, str(tmp_path / "hist"), str(tmp_path / "hc")).awaitTermination()
    assert spark.read.text(str(tmp_path / "hist")).count() == 1


def test_lines_keep_their_numbers_when_files_grow(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("\t one\r\n\n two \n")
    b.write_text("x\n")
    first = {(r.path[-7:], r.line_no): r.value for r in transcripts.read_lines(spark, str(tmp_path)).collect()}
    assert first == {("a.jsonl", 1): "one", ("a.jsonl", 3): "two", ("b.jsonl", 1): "x"}
    b.write_text("x\n" + "y\n" * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        again = {(r.path[-7:], r.line_no): r.value for r in transcripts.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(again) == 53 and all(again[k] == v for k, v in first.items()) and again["b.jsonl", 51] == "y"


def test_sample_buckets_keep_the_last_sample(spark, tmp_path):
    rows = [("2026-01-01 00:00:10", 1), ("2026-01-01 00:04:59", 2), ("2026-01-01 00:05:00", 3), ("2026-01-01 02:00:00", 4)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, n int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, n int").json(str(tmp_path / "in"))
    out = jobs.sample_buckets(stream, "5 minutes", "1 minute")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(str(r.bucket)[11:16], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("00:00", 2), ("00:05", 3)}


def test_a_repeated_batch_of_history_replaces_its_own(spark, tmp_path):
    row = spark.range(1).select(F.lit(1_782_561_600_000_000).alias("at_us"), *[F.lit(1).cast("long").alias(c) for c in history.METRICS], F.expr("array(named_struct('project', 'p'))").alias("projects"))
    row.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a new checkpoint each time, so the same batch 0 comes twice
        stream = spark.readStream.schema(row.schema).parquet(str(tmp_path / "in"))
        jobs.keep_history(stream, str(tmp_path / "h"), str(tmp_path / f"c{_}")).awaitTermination()
    assert spark.read.text(str(tmp_path / "h")).count() == 1
    assert jobs.tick(None) == jobs.tick(0) == {"availableNow": True} and jobs.tick(5) == {"processingTime": "30 seconds"}


def test_smoothing_takes_inner_values_for_missing_neighbours(spark):
    points = spark.createDataFrame([("r", i, v) for i, v in enumerate([9, None, 9, 18, 9, 0])], "range string, at_us long, n int")
    found = {r.at_us: r.smoothed for r in trends.smooth(points, ["range"], "n").collect()}
    assert found[0] == 9 and found[5] == 0 and found[2] == (9 + 18 + 27 + 36 + 9) / 9 and found[3] is not None
    assert trends.latest(points, ["range"], "n", 2).first().at_us == 2 and trends.latest(points, ["range"], "n", 1).first().at_us == 5
    seconds = spark.createDataFrame([(1_000_000, 1), (1_500_000, 2), (2_000_001, 3)], "at_us long, n int")
    assert {(r.at_us, r.n) for r in trends.history_points(seconds, ["n"]).collect()} == {(1_000_000, 2), (2_000_000, 3)}
    assert intervals.day_start(1_706_652_000_000_000, "UTC") == 1_706_572_800_000_000
    assert intervals.day_start(1_706_652_000_000_000, "Asia/Tokyo") == 1_706_626_800_000_000


def test_late_lines_repair_bursts(spark, tmp_path):
    import os
    import random

    from sessionloom.streaming.bursts import current_bursts, keep_bursts, repaired

    rng = random.Random(3)
    day = 86_400_000_000
    rows = [(rng.choice("abc"), rng.choice((1, 2)), rng.randrange(4 * day // 60_000_000) * 60_000_000 - day) for _ in range(900)]
    rows += [("hot", 1, i * 90_000_000) for i in range(400)] + rows[:50]
    kind = "k string, n int, ts_us long"
    want = lambda r: sorted(tuple(x) for x in intervals.burst_spans(spark.createDataFrame(r, kind), ["k", "n"], 90, 0).select("k", "n", "start_us", "end_us", "events").collect())
    old = [r for r in rows if r[2] % 7]
    first = intervals.burst_spans(spark.createDataFrame(old, kind), ["k", "n"], 90, 0)
    late = spark.createDataFrame([r for r in rows if not r[2] % 7], kind)
    found = repaired(first, late, ["k", "n"], 90)
    assert sorted(tuple(x) for x in found.select("k", "n", "start_us", "end_us", "events").collect()) == want(rows)
    rng.shuffle(rows)  # every batch brings lines up to days late
    for at in range(0, len(rows), 500):
        spark.createDataFrame(rows[at : at + 500], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "kept")
    keep_bursts(stream, ["k", "n"], 90, 3600, root, str(tmp_path / "c"), buckets=4).awaitTermination()
    assert len(os.listdir(f"{root}/late")) >= 2 and spark.read.parquet(f"{root}/late").where("ts_us is null").count() == 0
    kept = current_bursts(spark, root, ["k", "n"], stream.schema).drop("bucket")
    assert sorted(tuple(x) for x in kept.collect()) == want(rows)


def test_streamed_buckets_of_all_ranges(spark, tmp_path):
    now = 1_782_561_600_000_000
    samples = [(now - i * 1_234_567_890, i) for i in range(2200)] + [(now, -1), (now - 86_400_000_000, 7), (now + 1, 9)]
    frame = spark.createDataFrame(samples, "at_us long, v long")
    frame.repartition(3).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    jobs.range_buckets(stream, now).writeStream.format("memory").queryName("ranges").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("ranges").collect())) == sorted(map(tuple, trends.runtime_trends(frame, now).collect()))
    assert spark.table("ranges").where(f"range = '1D' and at_us = {now}").first()["bucket"] == 48  # the one at the end
