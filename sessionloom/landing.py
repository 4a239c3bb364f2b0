"""Tables written once and read by several branches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of its own in the folder that all executors share, ``spark.checkpoint.dir``; only where that is unset on a single machine, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/loom-{name}-{uuid.uuid4().hex[:12]}"


def land(frame: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches of a query read, and read it back: a lost executor costs no more than its tasks."""
    spark = frame.sparkSession
    path = new_root(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
