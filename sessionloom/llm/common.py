"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20
#: Folder used where spark.checkpoint.dir is unset, as in tests.
_own_folder: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster it is ``spark.checkpoint.dir``; only where that is unset on a
    single machine, as in tests, does it fall back to a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-loom-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/loom-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at a table that survives lost executors, and computes
    ``df`` once however often the result is used.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Have Spark send rows to Python in Arrow batches of about BATCH_BYTES, unless the session sets a bound of its own.

    By default a batch is 10,000 rows or 64 MB, which for whole texts is a task's entire share
    of the input, held by the JVM while it is written and by the worker that reads it.
    Rows are never cut: one longer than the bound is a batch by itself.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, the only columns that most operators read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """Names for an operator's own columns: the wanted ones, with "_" after those that the input already has."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for frame in frames:
        for file in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_bucket(column: Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo ``buckets``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` long pairs.

    Returns ``(node, component)`` for every node of an edge; the component is
    the smallest node id in it. Alternating large-star and small-star rounds:
    every round is a grouping by node with a map-side minimum and a join back to
    one row a node, in which adaptive execution splits the links of a hub, so no
    component is ever held in one task, and the number of
    rounds grows with the logarithm of the longest path. No edges give no rows;
    edges with a null end are ignored.
    """
    current = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    digest = None
    while True:
        # large star: each larger neighbour of u, and u, point to u's smallest neighbour
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        # small star: each smaller neighbour of u, and u, point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = materialize(
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct(),
            "small",
        )
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_tables(small.sparkSession, current, large)
        current = small
        if tuple(seen) == digest:
            break
        digest = tuple(seen)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
