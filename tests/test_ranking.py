import random

from pyspark.sql import functions as F

from sessionloom.operators.ranking import with_place


def test_places_are_those_of_a_sort(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), f"k{i}") for i in range(3000)]
    rng.shuffle(rows)
    found = with_place(spark.createDataFrame(rows, "n long, key string").repartition(7), F.desc("n"), "key").collect()
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert len(found) == len(rows) and all(want[r.n, r.key] == r.place for r in found)


def test_no_rows_and_nulls(spark):
    empty = spark.createDataFrame([], "n long")
    assert with_place(empty, "n").collect() == []
    found = with_place(spark.createDataFrame([(None,), (2,), (1,)], "n long"), F.asc_nulls_last("n")).collect()
    assert sorted((r.place, r.n) for r in found) == [(1, 1), (2, 2), (3, None)]
