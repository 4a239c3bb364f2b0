"""Mixing sources to target weights (operator 2), by Sainte-Lague apportionment.

Equal-word blocks go to the sources with the highest quotients, then within a
source to its shards; a shard takes as many whole passes over its documents as
its quota holds and the rest from its documents in a seeded order. That order is
one of keys drawn from the rows themselves, so a shard's decision is a single key
up to which rows are taken once more, and no text moves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import materialize

#: A run of what is not an ASCII blank.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Tables of at most so many narrow rows are broadcast; larger ones are joined by shuffles.
FEW = 100_000


def target_words(sizes: list[int], cycle: tuple[float, ...] = (5, 2, 1), most: float = 3) -> list[float]:
    """Targets of sources in order: shares by the cycle's weights, none above ``most`` times its size."""
    size = np.asarray(sizes, float)
    weight = np.resize(np.asarray(cycle, float), len(size))
    target, open_, rest = np.zeros(len(size)), np.ones(len(size), bool), float(sum(sizes))
    while open_.any():
        share = rest * weight / weight[open_].sum()
        above = open_ & (share > most * size)
        if not above.any():
            target[open_] = share[open_]
            break
        target[above] = most * size[above]
        rest -= target[above].sum()
        open_ &= ~above
    return target.tolist()


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 * seats + 1), none above its cap; ties to the earlier one."""
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[weights > 0].sum()))
    held = np.zeros(len(weights), np.int64)
    if seats <= 0:
        return held
    if len(weights) == 1:
        return np.array([seats])
    rounded = lambda d: np.minimum(caps, np.floor(weights / d + 0.5).astype(np.int64))
    low, high = weights[weights > 0].min() / (2 * seats + 2), 2 * weights.sum() + 1  # a divisor with too many seats, one with none
    for _ in range(100):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if rounded(middle).sum() > seats else (low, middle)
    held = rounded(high * (1 + 1e-9))  # none of those that tie at the divisor; the queue takes them in order
    queue = [(-w / (2 * h + 1), i) for i, (w, h, c) in enumerate(zip(weights, held, caps, strict=True)) if h < c and w > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(held.sum())):
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * held[i] + 1), i))
    return held


def joined(rows: DataFrame, table: DataFrame, keys: list[str], many: int, spread: Column, salts: int = 32) -> DataFrame:
    """Each of the rows with its row of ``table``, which has ``many`` rows and each key once.

    A table of FEW rows at most is broadcast. Beyond that both are shuffled by
    key and salt, so that the rows of a frequent key are dealt to many tasks.
    """
    if many <= FEW:
        return rows.join(F.broadcast(table), keys, "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int")).join(salted.hint("merge"), [*keys, "salt"], "left").drop("salt")


def shard_seats(cells: DataFrame, quotas: DataFrame, many: int, block: int, most: int) -> DataFrame:
    """``cells`` (known, name, shard, cell_size) with seats, the blocks of its source's quota (known, name, quota) that a shard gets by Sainte-Lague.

    No shard gets more blocks than ``most`` times its size needs; ties go to the smaller shard. ``many`` is the number of sources.
    A divisor gives a source's n shards within n / 2 of the seats in proportion to it, so two divisors enclose the quota:
    shards hold what the larger one gives, and of the quotients between both, some 2 * n, the highest fill the rest.
    """
    source = ["known", "name"]
    cap = F.floor((F.col("cell_size") * most + (block - 1)) / block).cast("long")
    own = cells.where("cell_size > 0").withColumn("cap", cap)
    totals = own.groupBy(*source).agg(F.sum("cell_size").alias("all_words"), F.count("*").alias("n"), F.sum("cap").alias("all_caps"))
    totals = joined(totals, quotas, source, many, F.lit(0)).withColumn("quota", F.least("quota", "all_caps"))
    reach = lambda seats: F.floor((F.col("cell_size") * seats * 2 / F.col("all_words") + 1) / 2).cast("long")
    # one more and one less than computed: what rounding may be off
    base = F.greatest(F.lit(0), F.least("cap", reach(F.col("quota") - F.col("n") / 2) - 1))
    top = F.greatest(F.least("cap", reach(F.col("quota") + F.col("n") / 2) + 1), F.lit(0))
    held = joined(own, totals, source, many, F.col("shard")).withColumns({"base": base, "top": top})
    held = materialize(held.select(*source, "shard", "cell_size", "cap", "quota", "base", "top"), "seats")
    sums = held.groupBy(*source).agg(F.sum("base").alias("bases"), F.sum("top").alias("tops"))
    between = joined(held, sums, source, many, F.col("shard")).withColumn("top", F.when(F.col("tops") < F.col("quota"), F.col("cap")).otherwise(F.col("top")))
    between = between.where("top > base").withColumn("h", F.explode(F.sequence("base", F.col("top") - 1)))
    best = Window.partitionBy(*source).orderBy(F.desc(F.col("cell_size") / (2 * F.col("h") + 1)), "shard")
    won = between.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.col("quota") - F.col("bases")).groupBy(*source, "shard").agg(F.count("*").alias("won"))
    return held.join(won, [*source, "shard"], "left").select(*source, "shard", "cell_size", (F.col("base") + F.coalesce("won", F.lit(0))).alias("seats"))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``row`` (all columns of a row), its size in words, its source and its key in the seeded order.

    The key is drawn from doc_id and text, so equal rows share one.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), said("doc_id"), F.lit("|"), said("text")).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"), drawn.alias("drawn"),
    ).withColumns({"key": F.substring("drawn", 1, 16), "hash": F.conv(F.substring("drawn", 17, 8), 16, 10).cast("long")}).drop("drawn")


def decided(rows: DataFrame, narrow: DataFrame, cycle: tuple[float, ...], most: int, cell_words: int, blocks: int) -> DataFrame:
    """Add source_size, target and taken to ``rows``; the decisions come from ``narrow``, the same rows without their text.

    The driver gets one row for each source, sums only; shards get their seats in Spark.
    """
    spark = rows.sparkSession
    found = narrow.groupBy("known", "name").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (not r.known, r.name))
    sizes = [r["size"] for r in found]
    total, targets = sum(sizes), target_words(sizes, cycle, most)
    cell = max(1, total // max(512, total // cell_words))
    # Arrow tables, as lists of tuples start Python workers of another kind on every executor
    known, name = pa.array([r.known for r in found], pa.bool_()), pa.array([r.name for r in found], pa.string())
    shards_of = pa.array([-(-s // cell) or 1 for s in sizes], pa.int64())
    columns = {"known": known, "name": name, "source_size": pa.array(sizes, pa.int64()), "target": pa.array(targets, pa.float64()), "shards": shards_of}
    sources = spark.createDataFrame(pa.table(columns))
    shard = (F.col("hash") % F.col("shards")).alias("shard")
    in_source = lambda x: joined(x, sources, ["known", "name"], len(found), F.col("hash"))
    # equal rows are one unit of the seeded order, counted on the map side
    units = in_source(narrow.where("size > 0")).groupBy("known", "name", shard, "key", "size").agg(F.count("*").alias("rows"))
    units = materialize(units, "units")
    cells = materialize(units.groupBy("known", "name", "shard").agg(F.sum(F.col("size") * F.col("rows")).alias("cell_size")), "cells")
    block = min(1024, max(1, total // blocks))
    seats = sainte_lague(targets, round(total / block), [-(-most * x // block) for x in sizes])
    quotas = spark.createDataFrame(pa.table({"known": known, "name": name, "quota": pa.array(seats, pa.int64())}))
    words = F.least(F.col("seats") * block, F.col("cell_size") * most)
    plan = shard_seats(cells, quotas, len(found), block, most)
    plan = plan.select("known", "name", "shard", F.floor(words / F.col("cell_size")).cast("long").alias("passes"), (words % F.col("cell_size")).alias("rest"))
    plan, shards = materialize(plan, "plan"), cells.count()
    order = Window.partitionBy("known", "name", "shard").orderBy("key", "size")
    words = F.col("size") * F.col("rows")
    before = F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - words
    placed = joined(units.withColumn("before", before), plan, ["known", "name", "shard"], shards, F.xxhash64("key"))
    edges = placed.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + words)).select(
        "known", "name", "shard", "passes", F.col("key").alias("edge_key"), F.col("size").alias("edge_size"),
        F.floor((F.col("rest") - F.col("before")) / F.col("rows")).cast("long").alias("edge_part"),
    )
    edges = materialize(edges, "edges")
    out = joined(in_source(rows).withColumn("shard", shard), edges, ["known", "name", "shard"], shards, F.xxhash64("key"))
    once_more = F.expr("case when key < edge_key or key = edge_key and size < edge_size then size when key = edge_key and size = edge_size then edge_part else 0 end")
    return out.withColumn("taken", F.when(F.col("size") > 0, F.col("passes") * F.col("size") + once_more).otherwise(F.lit(0).cast("long")))


def mix_sources(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7, cell_words: int = 10_000_000, blocks: int = 1 << 20) -> DataFrame:
    """How many words the mix takes of each document.

    Sources in order of code point, null last, weigh as ``cycle`` repeats.
    Shards hold about ``cell_words`` words (at least 512 shards in all), a
    block a ``blocks``-th of all words up to 1024. Returns ``doc_id, source,
    size, source_size, target, taken`` for every row.

    Null and blank texts have size 0 and nothing taken; a null source is a
    source of its own. Repeated rows (the same doc_id and text) share a place in
    the seeded order and are taken alike, rounded down; rows that share only a
    null or repeated doc_id have places of their own. Equal sizes go by
    key. A text's length is not bounded: the last document that a shard takes is
    taken in part. An empty table gives no rows. Further columns are ignored,
    whatever their names.
    """
    rows = keyed(docs.select("doc_id", "text", "source"), seed)
    narrow = materialize(rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", "known", "name", "key", "hash"), "sized")
    out = decided(narrow, narrow, cycle, most, cell_words, blocks)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7, cell_words: int = 10_000_000, blocks: int = 1 << 20) -> DataFrame:
    """The mixed documents themselves: each as many times as it is taken, a last part cut to its words.

    Decisions are those of ``mix_sources``, for each row by its key. Documents of
    which nothing is taken are left out, those without words among them. All
    columns pass through, whatever their names; ``n_chars``, where there is one,
    is the new text's length. Nulls, ties, repeated rows, long texts and empty
    tables are as there.
    """
    rows = keyed(docs, seed)
    narrow = materialize(rows.select("size", "known", "name", "key", "hash"), "sized")
    mixed = decided(rows, narrow, cycle, most, cell_words, blocks).where("taken > 0")
    mixed = mixed.withColumn("nth", F.explode(F.expr("sequence(1, cast((taken + size - 1) div size as int))")))
    words = F.col("taken") - (F.col("nth") - 1) * F.col("size")
    led = F.regexp_extract_all("row.text", F.lit("[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++"), F.lit(0))  # words with the blanks before them
    some = F.array_join(F.slice(led, F.lit(1), words.cast("int")), "")
    mixed = mixed.select("row", F.when(words >= F.col("size"), F.col("row.text")).otherwise(some).alias("text"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "long"))}
    return mixed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
