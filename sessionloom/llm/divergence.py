"""Divergence of a language's sources by their terms (operator 13).

Equal texts of a language are one row with how often each source holds it, so
each is cut into terms once and its counts and document frequencies are added
with those weights. All terms that a group lacks have one probability, so a pair of
sources is summed from what each has alone, by how many terms share a
probability, and from corrections for the terms that both have.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm import runs
from sessionloom.llm.common import drop_tables, materialize

#: Bytes of a term: ASCII letters and all beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Pairs of sources whose corrections are computed at once in a task.
PAIRS = 1 << 21


def collapsed(docs: DataFrame) -> DataFrame:
    """(lid, text, held): each text of a language once, with the number of each group that holds it and how often.

    ``docs`` has lid, gid and text. Copies are counted by fingerprint, in narrow rows and before any shuffle, so
    texts move once, one a map task of any group of copies.
    """
    keyed = docs.where("text <> ''").withColumn("fp", F.unhex(F.sha2("text", 256)))
    texts = keyed.groupBy("lid", "fp").agg(F.first("text").alias("text"))
    copies = keyed.groupBy("lid", "fp", "gid").agg(F.count("*").alias("copies"))
    held = copies.groupBy("lid", "fp").agg(F.collect_list(F.struct("gid", "copies")).alias("held"))  # at most the sources of a language
    return texts.join(held, ["lid", "fp"]).select("lid", "text", "held")


def term_cells(texts: DataFrame) -> DataFrame:
    """(lid, gid, term, n, docs): places of each term in each group, and its documents that have it."""

    def cells(batches):
        for batch in batches:
            lids = batch.column("lid").to_numpy()
            held = batch.column("held")
            ends, flat = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            gids, copies = flat.field("gid").to_numpy(), flat.field("copies").to_numpy()
            for at, _, text, codes, times, words in runs.word_counts(batch.column("text"), lambda d: TERM[d]):
                many = ends[at + text + 1] - ends[at + text]  # each text's counts, once for each group that holds it
                place = np.repeat(ends[at + text] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                groups, own = np.unique(gids[place], return_inverse=True)
                key = own * max(1, len(words)) + np.repeat(codes, many)
                order = np.argsort(key, kind="stable")
                if not len(order):
                    continue
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                docs = np.add.reduceat(copies[place][order], first)
                n = np.add.reduceat((np.repeat(times, many) * copies[place])[order], first)
                lid = np.repeat(lids[at + text], many)[order][first]
                group, code = np.divmod(key[order][first], len(words))
                columns = [pa.array(lid), pa.array(groups[group]), words.take(pa.array(code)).cast(pa.string()), pa.array(n), pa.array(docs)]
                for low in range(0, len(first), 200_000):  # smaller batches on the way back
                    yield pa.RecordBatch.from_arrays([c.slice(low, 200_000) for c in columns], ["lid", "gid", "term", "n", "docs"])

    parts = texts.mapInArrow(cells, "lid long, gid long, term string, n long, docs long")
    return parts.groupBy("lid", "gid", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), in two steps that 64 bits hold up to a total of 10**14; null without terms."""
    d = f"nullif({total} + {terms}, 0)"
    part = f"((({n} + 1) % {d}) * 32000L)"
    return F.expr(f"if({terms} = 0, null, 1L + (({n} + 1) div {d}) * 1000000000L + ({part} div {d}) * 31250L + (({part} % {d}) * 31250L) div {d})")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def common_terms(scored: DataFrame) -> DataFrame:
    """(gid, other, value): what the terms that both sources of a pair have add to a sum over each one's own terms.

    A term's groups are one list, no longer than the sources of its language;
    tasks return sums by pair, not pairs by term.
    """
    lists = scored.groupBy("lid", "term").agg(F.collect_list(F.struct("gid", "p", "z")).alias("held")).where("size(held) > 1")

    def sums(batches):
        for batch in batches:
            held = batch.column(0)
            ends, flat = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            groups, own = np.unique(flat.field("gid").to_numpy(), return_inverse=True)
            p, z = flat.field("p").to_numpy(), flat.field("z").to_numpy()
            k, sizes = len(groups), np.diff(ends)
            blocks = []
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                left = min(size, max(1, PAIRS // size))
                some = max(1, PAIRS // (size * left))
                blocks += [(ends[rows[low : low + some]][:, None] + np.arange(size), a, a + left) for low in range(0, len(rows), some) for a in range(0, size, left)]
            f = lambda u, v: (u - v) * (u - v) // v
            for at, low, high in blocks:
                x = at[:, low:high]
                pa_, za, pb, zb = p[x][:, :, None], z[x][:, :, None], p[at][:, None, :], z[at][:, None, :]
                value = (f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)).reshape(-1)
                key = (own[x][:, :, None] * k + own[at][:, None, :]).reshape(-1)
                pairs, place = np.unique(key, return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, place, value)
                one, other = np.divmod(pairs, k)
                used = one != other
                yield pa.RecordBatch.from_arrays([pa.array(groups[one[used]]), pa.array(groups[other[used]]), pa.array(total[used])], ["gid", "other", "value"])

    return lists.select("held").mapInArrow(sums, "gid long, other long, value long")


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """How far the sources of each language differ from each other, and each one's terms that stand out of the language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased;
    a language keeps those in at least ``least_docs`` of its documents, repeated rows counted each. Returns
    lang, source, part, item, value, rank: in part ``pair`` the other
    sources of the language, in part ``term`` the ``top`` terms that the source
    has more often than the language. Equal values go by item.

    Null lang, source and text are read as ''. A source without terms is paired
    all the same; a language without kept terms has value 0 for all its pairs;
    one with a single source has none. Texts of any length are
    read whole; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    numbered = materialize(read.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    numbered = numbered.join(numbered.groupBy("lang").agg(F.min("gid").alias("lid")), "lang")
    texts = collapsed(read.join(numbered, ["lang", "source"]).select("lid", "gid", "text"))
    cells = term_cells(texts)
    of_term = Window.partitionBy("lid", "term")  # a row a source
    kept = cells.select(
        "lid", "gid", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("of_lang"), (F.min("gid").over(of_term) == F.col("gid")).alias("one")
    ).where(F.col("docs") >= least_docs)
    kept = materialize(kept, "kept")
    langs = kept.groupBy("lid").agg(F.sum("n").alias("lang_total"), F.count_if("one").alias("terms"))
    totals = kept.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = numbered.join(totals, "gid", "left").join(langs, "lid", "left").na.fill(0, ["total", "lang_total", "terms"])
    groups = materialize(groups.withColumn("z", probability("0L", "total", "terms")), "totals")

    scored = kept.join(groups.select("gid", "total", "lang_total", "terms", "z"), "gid").withColumns(
        {"p": probability("n", "total", "terms"), "q": probability("of_lang", "lang_total", "terms")}
    )
    scored = materialize(scored.select("lid", "gid", "term", "p", "q", "z"), "scored")
    best = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    terms = scored.where("p > q").select("gid", F.col("term").alias("item"), gap("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    others = groups.select("lid", F.col("gid").alias("other"), F.col("z").alias("other_z"))
    pairs = groups.select("lid", "gid", "z", "terms").join(others, "lid").where("gid <> other")
    base = pairs.select("gid", "other", F.expr("if(terms = 0, 0L, terms * ((z - other_z) * (z - other_z) div other_z))").alias("value"))
    alike = scored.groupBy("lid", "gid", "z", "p").agg(F.count("*").alias("m")).join(others, "lid").where("gid <> other")
    ahead = alike.select("gid", "other", (F.col("m") * (gap("p", "other_z") - gap("z", "other_z"))).alias("value"))
    back = alike.select(F.col("other").alias("gid"), F.col("gid").alias("other"), (F.col("m") * (gap("other_z", "p") - gap("other_z", "z"))).alias("value"))
    summed = base.union(ahead).union(back).union(common_terms(scored)).groupBy("gid", "other").agg(F.sum("value").alias("value"))
    names = numbered.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    pair = summed.join(names, "other").select("gid", "item", "value", F.row_number().over(best).alias("rank"), F.lit("pair").alias("part"))

    out = pair.unionByName(terms).join(numbered.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
    out = materialize(out, "audit")
    drop_tables(spark, kept, scored)
    return out
