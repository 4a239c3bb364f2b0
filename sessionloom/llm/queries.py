"""Queries of the corpus operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import ann, divergence, embedding_dedup, licenses, mixing, neardup, packing, pii, quality, secrets, spelling, token_files, toxicity
from sessionloom.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op2_source_mix(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op10_token_files(spark, folder):
    return token_files.token_round_trip(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


@query
def op5_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op1_licenses(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("places")


@query
def op9_personal_data(spark, folder):
    return pii.replace_personal_data(table(spark, folder, "documents").select("doc_id", "text"), pii.surrogate_key(spark))


@query
def op3_nearest(spark, folder):
    rows = table(spark, folder, "embeddings")
    return ann.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))


@query
def op4_near_vectors(spark, folder):
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


@query
def op7_toxicity(spark, folder):
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_terms")


@query
def op6_quality(spark, folder):
    scored = quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "quality_score", "text_score", "metadata_score", (F.col("quality_score") >= 0.5).alias("kept"))


@query
def op11_spelling_variants(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


@query
def op12_secrets(spark, folder):
    return secrets.find_secrets(table(spark, folder, "documents"))


@query
def op13_source_audit(spark, folder):
    return divergence.audit_sources(table(spark, folder, "documents"))


@query
def pipeline(spark, folder):
    import corpus_pipeline  # it takes its tables from this module

    return corpus_pipeline.run(spark, folder)
