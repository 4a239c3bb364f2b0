"""Near-duplicate documents by SuperMinHash (operator 5).

Texts with equal shingle sets are one class, whose smallest doc_id stands for
it. Signatures are cut into bands; in each bucket of a band every class is
compared with the bucket's smallest, on full sets, and then across whatever
components are left in the bucket, so a group of copies costs as many comparisons as
it has members. Union-find runs over the confirmed links, by Spark joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import shingles
from sessionloom.llm.common import bound_batches, connected_components, drop_tables, id_and_text, materialize

SKETCH = "doc_id long, text_key long, n_shingles long, fp1 long, fp2 long, bands array<long>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, which tells apart the texts of a repeated doc_id."""
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def sketches(docs: DataFrame, bands: int, rows: int, size: int = 5) -> DataFrame:
    """Set size, 128-bit set fingerprint and band keys of every whole text."""

    def sketch(batches):
        for batch in batches:
            for at, to, data, starts in shingles.text_chunks(batch.column(1)):
                sets = shingles.shingle_sets(data, starts, size)
                signature = shingles.superminhash(sets, bands * rows).reshape(len(sets), bands, rows)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
                for k in range(rows):
                    keys = shingles.mix(keys * shingles.ODD[4] + signature[:, :, k])
                n = np.array([len(s) for s in sets], np.int64)
                fp = [np.array([shingles.mix(s + c).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for c in shingles.ODD[:2]]
                held = shingles.lists([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)])
                columns = [batch.column(0)[at:to], batch.column(2)[at:to], pa.array(n), pa.array(fp[0]), pa.array(fp[1]), held]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "fp1", "fp2", "bands"])

    return keyed(docs).mapInArrow(sketch, SKETCH)


def full_sets(texts: DataFrame, size: int = 5) -> DataFrame:
    """(id, items) of every whole text of (id, text), its distinct hashed shingles in order."""

    def sets(batches):
        for batch in batches:
            for at, to, data, starts in shingles.text_chunks(batch.column(1)):
                found = shingles.lists(shingles.shingle_sets(data, starts, size))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], found], ["id", "items"])

    return texts.mapInArrow(sets, "id long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have at least so many percent of their union in common."""
    other = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    # the many members first, then the few leaders: each member's set moves once
    both = pairs.join(other, "b").join(one, "a")
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    counted = both.select("a", "b", common.alias("common"), (F.size("items_a") + F.size("items_b")).cast("long").alias("sizes"))
    return counted.where(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


def links_across(rest: DataFrame, sets: DataFrame, percent: int, block: int = 50_000) -> DataFrame:
    """Links between the components that share a bucket, as a spanning forest for each pair of blocks.

    ``rest`` has (key, id, part, weight): the members of the buckets, their component so
    far and the bucket's number of shingles. A bucket is cut into blocks of about
    ``block`` shingles, and each pair of its blocks is compared on full sets
    within a task, by counting common shingles for all their pairs at once.
    """
    pieces = F.ceil(F.col("weight") / block).cast("int")
    dealt = rest.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).join(sets, "id")
    blocks = materialize(dealt.groupBy("key", "piece").agg(F.collect_list(F.struct("id", "part", "items")).alias("rows")), "blocks")
    one = blocks.select("key", F.col("piece").alias("piece_a"), F.col("rows").alias("a"))
    other = blocks.select("key", F.col("piece").alias("piece_b"), F.col("rows").alias("b"))
    pairs = one.join(other, "key").where("piece_a <= piece_b").repartition("key", "piece_a", "piece_b")

    def compare(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                ids, parts, sizes, flat = zip(*(unpack(x.values) for x in (a, b)), strict=True)
                common = shingles.common_counts(flat[0], sizes[0], flat[1], sizes[1])
                union = sizes[0][:, None] + sizes[1] - common
                i, j = np.nonzero((100 * common >= percent * union) & (parts[0][:, None] != parts[1]))
                # of the links between the same two components one is enough
                _, first = np.unique(np.stack([parts[0][i], parts[1][j]], axis=1), axis=0, return_index=True)
                i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][i]), pa.array(ids[1][j])], ["a", "b"])

    return pairs.select("a", "b").mapInArrow(compare, "a long, b long")


def unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, set sizes and all items of the rows of a block."""
    items = rows.field("items")
    sizes = np.diff(items.offsets.to_numpy())
    return rows.field("id").to_numpy(), rows.field("part").to_numpy(), sizes.astype(np.int64), items.flatten().to_numpy()


def near_groups(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """For every row doc_id, text_key, n_shingles, component_id and first: whether it is the one of its group that has the
    smallest doc_id and, of several texts with that id, the smallest text_key.

    A doc_id may stand in several rows: each row goes by its own text, so its texts may fall into
    several groups. Rows alike in doc_id and text get the same answer.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sketched = materialize(sketches(docs, bands, rows, size), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    equal = ["fp1", "fp2", "n_shingles"]
    classes = usable.groupBy(*equal).agg(F.min(F.struct("doc_id", "text_key", "bands")).alias("r"))
    classes = materialize(classes.select(*equal, F.monotonically_increasing_id().alias("id"), "r.*"), "classes")
    entries = classes.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    shared = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("leader"), F.max("id").alias("last"))
    shared = shared.where("last <> leader.id").select("key", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"))
    members = materialize(entries.join(shared, "key"), "members")
    asked = classes.join(members.select("id").distinct(), "id").select("id", "doc_id", "text_key")
    # both sides are shuffled at any size, as how many texts share a bucket is not bounded; texts aren't sorted.
    # rows alike in doc_id and text_key are alike in text, so any of them will do
    texts = keyed(docs).join(asked.hint("shuffle_hash"), ["doc_id", "text_key"]).select("id", "text")
    sets = materialize(full_sets(texts, size).dropDuplicates(["id"]), "sets")
    similar = f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)"
    stars = members.where(f"id <> leader and {similar}").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(confirmed(stars, sets, percent), "links")
    parts = connected_components(links)
    # buckets that hold more than one component: the links between those may still be missing
    labelled = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "n", "leader", F.coalesce("component", "id").alias("part")
    )
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("many"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"),
        F.sum("n").alias("weight"),
    )
    # one of the buckets that hold the same members will do
    mixed = mixed.where("low < high").groupBy("many", "sum").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
    rest = labelled.join(mixed.select("key", "weight"), "key")
    more = links_across(rest, sets, percent)
    parts = connected_components(links.union(more)).withColumnRenamed("node", "id")
    placed = materialize(classes.join(parts, "id", "left").select(*equal, "doc_id", "text_key", F.coalesce("component", "id").alias("component")), "placed")
    # written, so that both sides of the join are plain shuffles and adaptive execution splits the classes of a large group
    best = materialize(placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("best")), "best")
    of_class = materialize(placed.join(best, "component").select(*equal, "best"), "components")
    drop_tables(spark, members, sets, links, labelled, placed, best)
    # a class's answer goes to its rows by their fingerprint; rows without doc_id or words are no one's
    mine = sketched.drop("bands").join(of_class, equal, "left")
    known = F.col("doc_id").isNotNull() & F.col("best").isNotNull()
    return mine.select(
        "doc_id", "text_key", "n_shingles", F.when(known, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~known | ((F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))).alias("first"),
    )


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """Group documents whose sets of ``size``-word shingles are similar to ``percent`` percent or more.

    Words are runs of what is not an ASCII blank, A-Z lower-cased. Returns for
    every row doc_id, n_shingles, component_id (the smallest doc_id reachable
    by links) and kept (whether that is the row's own).

    Texts without words and null texts have no shingles and link with nothing;
    texts of any length are read whole. Of documents alike the smallest id stands for the group.
    Rows go by their own text, those of a repeated doc_id too, and do not depend on the rows' order; repeated rows are kept together or dropped
    together. A null doc_id links with nothing, has no component and is kept. An empty
    table gives no rows; further columns are ignored.
    """
    return near_groups(docs, percent, size, bands, rows).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
