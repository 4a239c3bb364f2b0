"""Whole snapshot samples: the projection of a snapshot, its lines of any version, and a store with retention."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

from sessionloom.functions import text as T
from sessionloom.operators.history import RETENTION_US

#: Fields of a sample (fixed values). Lines written before a field existed lack it.
CURRENT = "pid_concurrency:bigint,session_concurrency:bigint,active_burst_concurrency:bigint"
SUMMARY = (
    "active_sessions:bigint,idle_sessions:bigint,main_agent_sessions:bigint,subagent_sessions:bigint,unknown_role_sessions:bigint,mapped_processes:bigint,"
    "unmapped_processes:bigint,multi_mapped_processes:bigint,project_count:bigint,hot_project_count:bigint,mapping_coverage_pct:double"
)
RISK = (
    "posture:string,active_project_count:bigint,recent_project_count:bigint,top_project:string,top_project_attention_share_pct:double,candidate_workitem_count:bigint,"
    "candidate_workitem_coverage_pct:double,stale_session_count:bigint,orphan_process_count:bigint,churn_session_count:bigint,project_spread_count:bigint,"
    "fragmentation_pct:double,load_ratio_pct:double,load_peak_value:bigint,load_peak_source:string,load_peak_at:string,"
    "duplicate_overlap_suspicion_count:bigint,duplicate_overlap_cluster_count:bigint"
)
PROJECT = (
    "project:string,session_count:bigint,active_burst_count:bigint,main_agent_sessions:bigint,subagent_sessions:bigint,unknown_role_sessions:bigint,"
    "process_count:bigint,attention_share_pct:double"
)
KINDS = {"bigint": LongType(), "double": DoubleType(), "string": StringType()}


def struct(fields: str) -> StructType:
    return StructType([StructField(name, KINDS[kind]) for name, _, kind in (f.partition(":") for f in fields.split(","))])


SAMPLE = StructType([*[StructField(n, struct(f)) for n, f in (("current", CURRENT), ("summary", SUMMARY), ("coordination_risk", RISK))], StructField("projects", ArrayType(struct(PROJECT)))])
#: Fields of projects and risk that a line leaves out where they are 0 or empty.
OPTIONAL = {"projects.main_agent_sessions", "projects.subagent_sessions", "projects.unknown_role_sessions", "coordination_risk.load_peak_source", "coordination_risk.load_peak_at"}


def conformed(value: Column | None, have: DataType | None, want: DataType, path: str = "", lines: bool = False) -> Column:
    """``value`` with just the fields of ``want``: 0, empty text or an empty list where it has none; for ``lines`` optional ones are null there."""
    if isinstance(want, StructType):
        kinds = {f.name: f.dataType for f in have.fields} if isinstance(have, StructType) else {}
        inner = lambda f: conformed(value[f.name] if f.name in kinds else None, kinds.get(f.name), f.dataType, f"{path}.{f.name}".lstrip("."), lines)
        return F.struct(*[inner(f).alias(f.name) for f in want.fields])
    if isinstance(want, ArrayType):
        if value is None:
            return F.array().cast(want)
        kind = have.elementType if isinstance(have, ArrayType) else None
        return F.coalesce(F.transform(value, lambda x: conformed(x, kind, want.elementType, path, lines)), F.array().cast(want))
    none = F.lit("" if isinstance(want, StringType) else 0).cast(want)
    out = none if value is None else F.coalesce(value.cast(want), none)
    return F.nullif(out, none) if lines and path in OPTIONAL else out


def projected(snapshots: DataFrame, lines: bool = False) -> DataFrame:
    """at_us and the four parts of a sample, from snapshots that may have more columns and fields, or fewer."""
    kinds = {f.name: f.dataType for f in snapshots.schema.fields}
    parts = [conformed(F.col(f.name) if f.name in kinds else None, kinds.get(f.name), f.dataType, f.name, lines).alias(f.name) for f in SAMPLE.fields]
    return snapshots.select("at_us", *parts)


def to_lines(snapshots: DataFrame) -> DataFrame:
    """(day, value): samples as JSON text, the time as RFC 3339."""
    stamp = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")
    body = projected(snapshots, lines=True)
    return body.select(F.to_date(F.timestamp_micros("at_us")).alias("day"), F.to_json(F.struct(stamp, *[f.name for f in SAMPLE.fields])).alias("value"))


def from_lines(lines: DataFrame, *order: str) -> DataFrame:
    """Whole samples of JSON lines of any version (value), the ``order`` columns beside; broken lines and times are left out."""
    line = StructType([StructField("at", StringType()), *SAMPLE.fields, StructField("broken", StringType())])
    said = lines.withColumn("s", F.from_json(T.stripped("value"), line, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}))
    said = said.withColumn("at_us", F.unix_micros(T.observed_time("s.at"))).where("at_us is not null and s.broken is null")
    parts = [conformed(F.col(f"s.{f.name}"), f.dataType, f.dataType, f.name).alias(f.name) for f in SAMPLE.fields]
    return said.select("at_us", *parts, *order)


def land_batch(snapshots: DataFrame, root: str, number: int) -> None:
    """Add a batch of samples to the store; a batch that is repeated replaces its own."""
    to_lines(snapshots).write.mode("overwrite").partitionBy("day").text(f"{root}/batches/batch={number}")


def manifest(spark: SparkSession, root: str) -> tuple[int, int]:
    """Version of the compacted samples and the last batch in them: 0 and -1 before the first compaction."""
    try:
        found = spark.read.schema("upto long, version long").parquet(f"{root}/manifest").agg(F.max(F.struct("version", "upto")).alias("m")).first().m
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, -1
    return (found.version, found.upto) if found else (0, -1)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The samples that the store holds: of each time the last one, none older than 30 days before the newest.

    Read are the compacted table that the newest manifest names and the batches after it, so a compaction
    that is under way, or broke off, shows nothing of itself.
    """
    version, upto = manifest(spark, root)
    kind = "value string, batch long"
    batches = spark.read.schema(kind).option("basePath", f"{root}/batches").option("recursiveFileLookup", "false").text(f"{root}/batches")
    lines = from_lines(batches.where(F.col("batch") > upto).select("value", "batch"), "batch")
    if version:
        lines = lines.unionByName(spark.read.parquet(f"{root}/compacted/version={version}").select("at_us", *[f.name for f in SAMPLE.fields], F.lit(-1).cast("long").alias("batch")))
    names = [f.name for f in SAMPLE.fields]
    last = lines.groupBy("at_us").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("at_us", "s.*")
    newest = lines.agg(F.max("at_us").alias("newest"))  # one row
    return last.crossJoin(F.broadcast(newest)).where(F.col("at_us") >= F.col("newest") - RETENTION_US).drop("newest")


def compact(spark: SparkSession, root: str) -> int:
    """Put the batches so far into one table without what retention drops, and name it in the manifest: one small file, written when the table is whole.

    Returns the new version. A compaction that broke off is done again under the same number; the tables of earlier versions stay for
    readers that still use them.
    """
    version, upto = manifest(spark, root)
    last = spark.read.schema("value string, batch long").text(f"{root}/batches").agg(F.max("batch")).first()[0]
    if last is None or last <= upto:
        return version
    out = stored(spark, root).withColumn("day", F.to_date(F.timestamp_micros("at_us")))
    out.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/compacted/version={version + 1}")
    spark.createDataFrame([(last,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version + 1}")
    return version + 1


def keep_samples(snapshots: DataFrame, root: str, checkpoint: str, every_s: int | None = None, compact_every: int = 100):
    """Land a stream of snapshots in the store and compact it each so many batches."""
    from sessionloom.streaming.jobs import tick

    def land(batch: DataFrame, number: int) -> None:
        land_batch(batch, root, number)
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, root)

    return snapshots.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**tick(every_s)).start()
