from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.operators import intervals, trends

S, M = 1_000_000, 60_000_000


def spans(spark, rows):
    return spark.createDataFrame([(a * M, b * M) for a, b in rows], "start_us long, end_us long")


def test_bursts_part_at_long_gaps_only(spark):
    events = spark.createDataFrame([("a", t * S) for t in (0, 10, 20, 180, 190)], "k string, ts_us long")
    found = intervals.burst_spans(events, ["k"], 90, 15).orderBy("start_us").collect()
    assert [(r.start_us // S, r.end_us // S) for r in found] == [(0, 20), (180, 195)]
    edge = spark.createDataFrame([("a", 0), ("a", 90 * S), ("a", 180 * S + 1)], "k string, ts_us long")
    assert intervals.burst_spans(edge, ["k"], 90, 15).count() == 2


def test_peak(spark):
    r = intervals.peak_concurrency(spans(spark, [(0, 5), (2, 7), (3, 4)]), -M, 10 * M).first()
    assert (r.peak, r.peak_at_us) == (3, 3 * M)
    assert intervals.peak_concurrency(spans(spark, []), 0, M).first().peak == 0
    touching = intervals.peak_concurrency(spans(spark, [(0, 1), (1, 2)]), 0, 5 * M).first()
    assert (touching.peak, touching.peak_at_us) == (1, 0)


def test_series_is_zero_at_its_last_point(spark):
    found = intervals.concurrency_series(spans(spark, [(-1, 2), (1, 4), (4, 5)]), 0, 5 * M, M).orderBy("at_us").collect()
    assert [r.level for r in found] == [1, 2, 1, 1, 1, 0]


def test_grid_ends_at_its_end(spark):
    assert [r.at_us for r in intervals.grid(spark, 0, 10, 4).orderBy("at_us").collect()] == [0, 4, 8, 10]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 120)), min_size=1, max_size=30))
def test_two_level_sweep_is_the_global_one(spark, rows):
    rows = [(a, a + n) for a, n in rows]
    r = intervals.peak_concurrency(spans(spark, rows), 0, 1000 * M).first()
    levels = {a: sum(x <= a < y for x, y in rows) for a, _ in rows}
    best = max(levels.values())
    assert (r.peak, r.peak_at_us) == (best, min(a for a, n in levels.items() if n == best) * M)


def test_normalize(spark):
    rows = [(None, 20 * S), (5 * S, None), (9 * S, 3 * S), (0, 100 * S), (None, None)]
    found = intervals.normalize(spark.createDataFrame(rows, "start_us long, end_us long"), 15).collect()
    assert sorted((r.start_us // S, r.end_us // S) for r in found) == [(0, 100), (5, 20), (9, 24), (20, 35)]


def test_runtime_buckets_keep_the_last_sample(spark):
    now = 100_000 * M
    rows = [(now - 55 * M, 2), (now - 35 * M, 4), (now - 10 * M, 3)]
    found = trends.runtime_trends(spark.createDataFrame(rows, "at_us long, pid long"), now).where("range = '1D'").orderBy("bucket").collect()
    assert [r.pid for r in found] == [4, 3]


def test_no_evidence_is_null_not_zero(spark):
    none = spark.createDataFrame([], "start_us long, end_us long")
    start = trends.evidence_start(spark.createDataFrame([], "ts_us long"), none, 0, 10 * M)
    points = trends.transcript_trends(none, none, start, 100 * 24 * 60 * M)
    assert points.where("sessions is not null or bursts is not null").isEmpty() and points.count() == 277
    assert trends.to_json_points(points.limit(1)).first().value.count("sessions") == 0
    assert trends.coverage(start, 10 * M).where("complete").isEmpty()


def test_smooth_leaves_ends(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((9, 0, 0, 9, 0))], "k string, at_us long, v double")
    found = [r.smoothed for r in trends.smooth(rows, ["k"], "v").orderBy("at_us").collect()]
    assert found[0] == 9 and found[-1] == 0 and abs(found[2] - (9 + 0 + 0 + 18 + 0) / 9) < 1e-9
