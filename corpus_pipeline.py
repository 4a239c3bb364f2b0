"""The corpus pipeline: score quality, drop near-duplicates, replace personal data, mix sources, pack.

Each stage takes all rows its predecessor kept and, but for the last, returns the
columns of documents. ``run`` writes every stage's result as Parquet in the
shared folder, reads it back for the next, and drops it when that is written.

Every stage takes null and empty texts, null ids, sources and languages, texts of
any length, repeated rows, empty tables and further columns of any name, which
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_tables, free_names, materialize
from sessionloom.llm.mixing import take_mix
from sessionloom.llm.neardup import near_groups
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.pii import replace_personal_data, surrogate_key
from sessionloom.llm.quality import score_quality
from sessionloom.llm.queries import table, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than not, a score of one half included; null and empty texts are scored as texts without words, repeated rows alike."""
    out = score_quality(docs, table(spark, sf_dir, "labels"))
    return out.where(F.col(out.columns[len(docs.columns)]) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Rows go by their own text: where an id is repeated, each of its texts stays or goes
    with its own group, and of rows alike in id and text one stays. Texts without words (null, empty or blank) are no one's
    duplicates, so all but such repeated rows stay, as do rows with a null id.
    """
    row = ["doc_id", "text_key"]
    groups = materialize(near_groups(docs).where("doc_id is not null").groupBy(*row, "first").count(), "groups")
    own, its_id, its_key = free_names(["own_key", "its_id", "its_key"], docs.columns)
    keyed = docs.withColumn(own, F.xxhash64("text"))
    by_row = lambda rows: rows.select(F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key)).hint("shuffle_hash")
    here = (F.col("doc_id").cast("long") == F.col(its_id)) & (F.col(own) == F.col(its_key))
    # ids of copies grow with the corpus, so they are never broadcast; texts are shuffled but not sorted
    kept = keyed.join(by_row(groups.where("not first")), here, "left_anti")
    twice = groups.where("first and count > 1")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(by_row(twice), here, "left_semi").dropDuplicates(["doc_id", own])
    return kept.join(by_row(twice), here, "left_anti").unionByName(one).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and their new lengths; null and empty texts and those without any stay as they are."""
    out = replace_personal_data(docs, surrogate_key(spark))
    places = out.columns[len(docs.columns)]
    changed = lambda c, t: F.when(F.col(places) > 0, F.length("text").cast(t)).otherwise(F.col(c)) if c == "n_chars" else F.col(f"`{c}`")
    return out.select(*[changed(c, t).alias(c) for c, t in docs.dtypes])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words go, as no words are taken of them. Rows alike in id and text are taken alike."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences of 2048; a document of any length is cut, repeated rows are packed each."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]
#: SQL has neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        done = materialize(stage(spark, docs, sf_dir), name)
        if at:  # the stage before is read no more
            drop_tables(spark, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
