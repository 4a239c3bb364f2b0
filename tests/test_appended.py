"""Appended byte ranges, tails and traces kept as state."""

import io
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.operators.traces import fold_traces
from sessionloom.sources import appended
from sessionloom.streaming import trace_state
from sessionloom.streaming.jobs import latest_traces

@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_hold_every_line_once(piece):
    rng = random.Random(piece)
    for _ in range(60):
        data = b"".join(b"x" * rng.randrange(6) + rng.choice((b"\n", b"\n\n", b"\r\n", b"")) for _ in range(rng.randrange(8)))
        begin = rng.choice([0, *[i + 1 for i, c in enumerate(data) if c == 10]])
        want, at = [], begin
        for line in data[begin:].split(b"\n"):
            if line or at < len(data):
                want.append((at, line))
            at += len(line) + 1
        want = [w for w in want if w[0] < len(data)]
        found = []
        cuts = [*range(begin, len(data), piece), len(data)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            cut_off = low > begin
            found += appended.lines_between(io.BytesIO(data), low - cut_off, high, len(data), cut_off, block=rng.randrange(1, 5))
        assert found == want, (data, begin)


def run(spark, root, where, **options):
    """What a batch of the stream brings, as (file, at, fresh, value)."""
    stream = appended.appended_lines(spark, f"file://{root}", **options)
    rows = []
    stream.writeStream.foreachBatch(lambda batch, number: rows.extend(batch.collect())).option("checkpointLocation", f"{where}/c").trigger(availableNow=True).start().awaitTermination()
    return sorted(((os.path.basename(r.path), r.at, r.fresh, r.value) for r in rows), key=repr)


def test_only_what_is_new_is_read(spark, tmp_path):
    root = tmp_path / "logs/.codex"
    (root / ".codexl/run").mkdir(parents=True)
    a, half, lane = root / "a.jsonl", root / "half.jsonl", root / ".codexl/run/events.jsonl"
    a.write_text("one\n\n  two \n")
    half.write_text("done\npart")
    lane.write_text("lane\n")
    (root / "skip.txt").write_text("x\n")
    where = str(tmp_path)
    first = [("a.jsonl", 0, True, "one"), ("a.jsonl", 5, True, "two"), ("events.jsonl", 0, True, "lane"), ("half.jsonl", 0, True, "done"), ("half.jsonl", 5, True, "part")]
    assert run(spark, root, where) == first
    assert run(spark, root, where) == []  # nothing changed
    grow = lambda f, t: f.open("a").write(t)
    grow(a, "three\nfour")
    grow(half, "ial\nnext\n")
    grow(lane, "more\n")
    assert run(spark, root, where) == [
        ("a.jsonl", 12, False, "three"), ("a.jsonl", 18, False, "four"), ("events.jsonl", 0, True, "lane"), ("events.jsonl", 5, True, "more"),
        ("half.jsonl", 0, True, "done"), ("half.jsonl", 13, True, "next"), ("half.jsonl", 5, True, "partial"),
    ]
    a.write_text("new\n")  # shorter
    half.write_text("DONE\nPARTial\nnext\nand more\n")  # longer, and other than it was
    assert run(spark, root, where, piece=4) == [("a.jsonl", 0, True, "new"), ("half.jsonl", 0, True, "DONE"), ("half.jsonl", 13, True, "next"), ("half.jsonl", 18, True, "and more"), ("half.jsonl", 5, True, "PARTial")]
    a.write_text("")
    half.unlink()
    assert run(spark, root, where) == [("a.jsonl", 0, True, None)]
    grow(a, "again\n")
    (root / "b.jsonl").write_text("long " * 100_000 + "\nshort\n")
    assert [(f, at, len(v)) for f, at, _, v in run(spark, root, where, piece=1000)] == [("a.jsonl", 0, 5), ("b.jsonl", 0, 499_999), ("b.jsonl", 500_001, 5)]


def test_a_batch_opens_new_bytes_alone(tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_text("x" * 9999 + "\n")
    reader = appended.AppendedReader({"path": f"file://{tmp_path}"})
    start = reader.latestOffset()
    log.open("a").write("y\n" * 10)
    end = json.loads(json.dumps(reader.latestOffset()))
    (part,) = reader.partitions(start, end)
    assert [(low, high) for _, low, high, *_ in part.ranges] == [(10_000, 10_020)]
    assert sum(b.num_rows for b in reader.read(part)) == 10
    assert reader.partitions(end, end) == []


def test_tails(spark, tmp_path):
    stamp = lambda h, **more: json.dumps({"timestamp": f"2026-06-28T{h:02}:00:00Z", **more})
    files = {
        "late.jsonl": stamp(1) + "\n" + stamp(20) + "\n", "early.jsonl": stamp(20) + "\n" + "x" * 400 + "\n" + stamp(1) + "\n\n", "none.jsonl": "no time\n", "empty.jsonl": "",
        "hidden.jsonl": stamp(1) + "\n" + "y" * 400 + "\n", "one.jsonl": stamp(1, more="z" * 400), "old.jsonl": stamp(20) + "\n", "other.txt": stamp(20),
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    os.utime(tmp_path / "old.jsonl", (1_000_000_000, 1_000_000_000))
    listed = appended.listing(spark, f"file://{tmp_path}")
    assert {(os.path.basename(r.path), r["size"]) for r in listed.collect()} == {(n, len(c)) for n, c in files.items() if n.endswith(".jsonl") and c}
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    cutoff = 1_782_619_200_000_000  # 2026-06-28 04:00
    empty = spark.createDataFrame([("file:///x/empty.jsonl", 0)], "path string, size long").withColumn("mtime", F.current_timestamp())
    listed = listed.unionByName(empty)
    held = {os.path.basename(r.path): r.may_hold for r in appended.may_hold_events_after(listed, cutoff, tail_bytes=256).collect()}
    # a tail whose only line is cut off, and one without a time, may hold some
    assert held == {"late.jsonl": True, "early.jsonl": False, "none.jsonl": True, "empty.jsonl": False, "hidden.jsonl": True, "one.jsonl": True, "old.jsonl": False}
    assert all(r.may_hold for r in appended.may_hold_events_after(listed, None).collect())
    lines = appended.tail_lines(listed.where("path like '%early%'"), 256).collect()
    assert [r["at"] for r in lines] == [len(stamp(20)) + 402]  # nothing before the first line end in the tail


def random_lines(rng, paths=4, n=150):
    rows = []
    for p in range(paths):
        for i in range(n):
            said = {"timestamp": f"2026-06-28T12:{rng.randrange(60):02}:{rng.randrange(60):02}Z"} if rng.random() < 0.7 else {}
            for key, values in (("sessionId", "ab"), ("thread_source", ["Human", "subagent", ""]), ("project", ["p", "q", ""]), ("parent_thread_id", ["x", ""]), ("agent_role", "rs")):
                if rng.random() < 0.1:
                    said[key] = rng.choice(values)
            if rng.random() < 0.2:
                said["payload"] = {"cwd": rng.choice(("/srv/one", "/srv/two", "/")), "agent_nickname": "n"}
            rows.append((f"/a/{p}/s.jsonl", ("claude", "codex")[p % 2], i * 7, json.dumps(said | {"type": rng.choice(("user", "assistant", "summary"))})))
    return rows


KIND = "path string, tool string, line_no long, value string"


def test_files_share_folders_and_appear_whole(spark, tmp_path):
    rows = [(f"{i % 3}/f{i}.txt", n, f"{i} {n} \u00e9") for i in range(40) for n in range(i * i)] + [("0/long.txt", n, "x" * 9) for n in range(25_000)]
    lines = spark.createDataFrame(rows, "file string, n int, value string").repartition("file").sortWithinPartitions("file", "n")
    for _ in range(2):  # as a task that runs again does
        appended.write_files(lines, f"file://{tmp_path}/w")
    assert sorted(os.listdir(tmp_path / "w")) == ["0", "1", "2"]
    want = {}
    for file, _, value in rows:
        want[file] = want.get(file, "") + value + "\n"
    found = {os.path.relpath(f"{d}/{n}", tmp_path / "w"): open(f"{d}/{n}").read() for d, _, names in os.walk(tmp_path / "w") for n in names if not n.endswith(".crc")}
    assert found == want
    listed = appended.listing(spark, f"file://{tmp_path}/w", "*.txt")
    assert listed.count() == len(want) and listed.rdd.getNumPartitions() <= appended.tasks(spark)
    assert appended.tail_lines(listed).rdd.getNumPartitions() == appended.tasks(spark)  # not all in one task
    appended.write_files(lines.where("false"), f"file://{tmp_path}/none")
    assert appended.listing(spark, f"file://{tmp_path}/none", "*.txt").count() == 0


def test_state_is_given_a_row_a_path():
    names = ["path", "tool", "fresh", "line_no", "said", "event_us", *trace_state.LAST, "named", "cwd", "stored", "hint", "independent"]
    rows = [("/a", "codex", False, n, True, n // 2, f"s{n}", None, None, None, None, None, f"c{n}" if n % 2 else None, None, None, True) for n in range(1000)]
    (batch,) = trace_state.folded(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)]))
    (row,) = batch.to_pylist()
    assert (row["session_id_line"], row["session_id"], row["name_line"], row["name"], row["source"]) == (999, "s999", 999, "c999", "transcript_cwd")
    assert row["times"] == list(range(500)) and row["independently_run"] and row["hint"] is None


def test_state_gives_what_folding_gives(spark, tmp_path):
    spark.conf.set(trace_state.STORE, trace_state.ROCKS)
    rng = random.Random(11)
    rows = random_lines(rng)
    again = rows + rng.sample(rows, 100)  # lines in any order, some of them twice
    rng.shuffle(again)
    for at in range(0, len(again), 250):
        spark.createDataFrame(again[at : at + 250], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    traces = str(tmp_path / "traces")
    trace_state.keep_trace_state(stream, traces, str(tmp_path / "c")).awaitTermination()
    assert len([d for d in os.listdir(traces) if d.startswith("batch=")]) > 1
    want = fold_traces(spark.createDataFrame(rows, KIND))
    found = latest_traces(spark, traces).where("events > 0").select(want.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 4


def test_files_read_anew_start_anew(spark, tmp_path):
    spark.conf.set(trace_state.STORE, trace_state.ROCKS)
    root = tmp_path / "logs"
    root.mkdir()
    line = lambda h, s: json.dumps({"timestamp": f"2026-06-28T{h:02}:00:00Z", "sessionId": s}) + "\n"

    def batch():
        lines = appended.appended_lines(spark, f"file://{root}").withColumn("tool", F.lit("codex")).withColumnRenamed("at", "line_no")
        trace_state.keep_trace_state(lines, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        return {os.path.basename(r.path): (r.session_id, r.events) for r in latest_traces(spark, str(tmp_path / "t")).collect()}

    (root / "a.jsonl").write_text(line(1, "s1") + line(2, "s2"))
    (root / "b.jsonl").write_text(line(1, "b"))
    assert batch() == {"a.jsonl": ("s2", 2), "b.jsonl": ("b", 1)}
    (root / "a.jsonl").open("a").write(line(2, "s3") + line(3, "s4"))
    assert batch() == {"a.jsonl": ("s4", 3), "b.jsonl": ("b", 1)}
    (root / "a.jsonl").write_text(line(5, "new"))
    (root / "b.jsonl").write_text("")
    assert batch() == {"a.jsonl": ("new", 1), "b.jsonl": (None, 0)}
