"""Spelling variants of a corpus's words (operator 11).

A word's openings are nodes of a forward trie, its endings nodes of a reversed
one. A word is cut into (opening, ending) pairs of node numbers, with all its
letters and with one skipped. Two words that differ in a replaced letter
share a pair with that letter skipped; one that has a letter more shares, with it skipped, a whole pair of
the other. So a pair has at most one whole word and one word for each letter of the alphabet, and
counts and best neighbours come from such small groups without writing any pair of words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import runs
from sessionloom.llm.common import drop_tables, materialize
from sessionloom.operators.ranking import with_place

#: Letters are a-z and U+00C0 to U+00FF, numbered from 1; their number is the tries' fan-out.
LETTERS = {c: i for i, c in enumerate([*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))], 1)}
FAN = len(LETTERS) + 1
#: Nodes down to this depth are numbered by their place in the complete trie, deeper ones by a table.
DEPTH = 9
#: Openings and endings up to this length are looked up as they are, longer ones by SHA-256.
PLAIN = 64
ASCII = np.zeros(256, bool)
ASCII[[*range(65, 91), *range(97, 123)]] = True
#: The rule of CRC-32, a byte at a time.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, np.uint32(0xEDB88320) ^ (CRC >> 1), CRC >> 1).astype(np.uint32)


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII letters or one of U+00C0 to U+00FF, which are 0xC3 and one more byte."""
    lead = data == 0xC3
    full = ASCII[data] | lead
    full[1:] |= lead[:-1]
    return full


def crc32_each(states: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 48) -> np.ndarray:
    """CRC-32 of many byte strings at once, each going on from a state of zlib.crc32."""
    order = np.argsort(-size, kind="stable")
    crc, begin, size = states[order] ^ np.uint32(0xFFFFFFFF), begin[order], size[order]
    for at in range(min(most, int(size.max(initial=0)))):
        n = int(np.searchsorted(-size, -at, side="left"))  # those with more than ``at`` bytes
        crc[:n] = CRC[(crc[:n] ^ data[begin[:n] + at]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    for i in range(int(np.searchsorted(-size, -most, side="left"))):  # the few longer ones
        crc[i] = zlib.crc32(data[begin[i] + most : begin[i] + size[i]].tobytes(), int(crc[i] ^ np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def word_table(docs: DataFrame, least_length: int, least_count: int, every: int) -> DataFrame:
    """(word, n) of all words of at least so many letters and places.

    Where ``every`` divides a CRC-32 h of ``<doc_id>:<run>``, that run, in that document, is a word without its letter at h modulo its length.
    """

    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, _, text, codes, times, words in runs.word_counts(batch.column(1), letter_bytes):
                _, offsets, values = words.buffers()
                offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
                data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
                leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
                length = np.diff(offsets) - (leads[offsets[1:]] - leads[offsets[:-1]])
                kept = length[codes] >= least_length
                text, codes, times = text[kept], codes[kept], times[kept]
                states = np.array([zlib.crc32(f"{'' if ids[at + i] is None else ids[at + i]}:".encode()) for i in range(int(text.max(initial=-1)) + 1)], np.uint32)
                h = crc32_each(states[text], data, offsets[codes], np.diff(offsets)[codes]) if len(text) else np.zeros(0, np.uint32)
                hit = h % every == 0
                whole = np.zeros(len(words), np.int64)
                np.add.at(whole, codes[~hit], times[~hit])
                cut: dict[str, int] = {}
                for code, own, n in zip(codes[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
                    word = words[code].as_py()
                    place = own % len(word)
                    if len(word) > least_length:
                        word = word[:place] + word[place + 1 :]
                        cut[word] = cut.get(word, 0) + n
                some = np.flatnonzero(whole)
                columns = [pa.concat_arrays([words.take(pa.array(some)).cast(pa.string()), pa.array(list(cut), pa.string())]), pa.array(np.concatenate([whole[some], np.array(list(cut.values()), np.int64)]))]
                for low in range(0, len(columns[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([c.slice(low, 200_000) for c in columns], ["word", "n"])

    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def node_names(letters: str) -> list[tuple[int | None, str | None]]:
    """For each opening of a word, from the empty one on, its node: a number, or the text or digest by which a deeper one is looked up."""
    out, number, digest = [(0, None)], 0, None
    for depth, letter in enumerate(letters, 1):
        if depth <= DEPTH:
            number = number * FAN + LETTERS[letter]
            out.append((number, None))
        elif depth <= PLAIN:
            out.append((None, letters[:depth]))
        else:
            digest = digest or hashlib.sha256(letters[: depth - 1].encode())
            digest.update(letter.encode())
            out.append((None, "#" + digest.hexdigest()))
    return out


CUTS = "id long, skipped int, p long, p_name string, s long, s_name string"


def node_pairs(words: DataFrame) -> DataFrame:
    """(id, skipped, p, s) of all cuts of words (id, word): opening and ending by node number.

    skipped is 0 for a cut of the whole word, 1 where a letter is left out, 2 where that gives what leaving out the letter before it gives.
    """

    def cuts(batches):
        for batch in batches:
            rows: list[tuple] = []
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                opening, ending = node_names(word), node_names(word[::-1])[::-1]
                rows += [(number, 0, *opening[i], *ending[i]) for i in range(len(word) + 1)]
                rows += [(number, 2 if i and word[i] == word[i - 1] else 1, *opening[i], *ending[i + 1]) for i in range(len(word))]
                if len(rows) >= 100_000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    def packed(rows):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["id", "skipped", "p", "p_name", "s", "s_name"])

    spark = words.sparkSession
    named = materialize(words.repartition("id").select("id", "word").mapInArrow(cuts, CUTS), "cuts")
    deep = named.where("p is null or s is null")
    # numbers of deep nodes begin where those of the complete trie end
    numbered = lambda c: materialize(deep.select(c).where(f"{c} is not null").distinct().withColumn(f"{c}_id", F.monotonically_increasing_id() + F.lit(FAN**DEPTH)), c)
    # a cut without a name on one side looks up one that no node has, of its own, so that nulls don't meet in one task
    look = lambda c: F.coalesce(c, F.concat(F.lit("."), F.col("id").cast("string")))
    opening, ending = numbered("p_name"), numbered("s_name")
    found = deep.withColumns({"p_name": look("p_name"), "s_name": look("s_name")}).join(opening, "p_name", "left").join(ending, "s_name", "left")
    known = named.where("p is not null and s is not null").select("id", "skipped", "p", "s")
    out = materialize(known.union(found.select("id", "skipped", F.coalesce("p", "p_name_id").alias("p"), F.coalesce("s", "s_name_id").alias("s"))), "pairs")
    drop_tables(spark, named, opening, ending)
    return out


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near each one, and the smallest id of them."""
    members = pairs.groupBy("p", "s").agg(
        F.min(F.when(F.col("skipped") == 0, F.col("id"))).alias("whole"),  # one at most
        F.sort_array(F.collect_list(F.when(F.col("skipped") > 0, F.col("id")))).alias("skip"),  # one for each letter at most
        F.collect_list(F.when(F.col("skipped") == 1, F.col("id"))).alias("first"),
    )
    members = members.where("size(skip) + if(whole is null or size(first) = 0, 0, 1) > 1")
    replaced = "transform(skip, x -> struct(x as id, size(skip) - 1 as n, if(x <> skip[0], skip[0], try_element_at(skip, 2)) as best))"
    longer = "transform(first, x -> struct(x as id, if(whole is null, 0, 1) as n, whole as best))"
    shorter = "if(whole is null, array(), array(struct(whole as id, size(first) as n, array_min(first) as best)))"
    found = members.select(F.explode(F.expr(f"concat({replaced}, {longer}, {shorter})")).alias("x")).select("x.*").where("n > 0")
    return found.groupBy("id").agg(F.sum("n").cast("long").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): where following the forms ends. Each round doubles the steps seen; a form has several times its word's count, so there are few."""
    reach = materialize(forms.select("id", F.col("form").alias("root")), "reach")
    while True:
        on = reach.select(F.col("id").alias("root"), F.col("root").alias("further"))
        wider = materialize(reach.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "reach")
        drop_tables(reach.sparkSession, reach)
        reach = wider.select("id", "root")
        if wider.where("moved").isEmpty():
            return reach


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, every: int = 199) -> DataFrame:
    """The words of all documents with the more frequent forms they are spelling variants of.

    Runs of ASCII letters and U+00C0 to U+00FF in whole texts, A-Z lower-cased;
    of the runs that a hash of document and run picks, one in ``every``, a letter is left out. Words
    have at least ``least_length`` letters and ``least_count`` places. Returns word, n, n_near (words that
    differ by one inserted, deleted or replaced letter), form (the near word of largest n, ties to the
    smallest, if it has ``times`` the places; else null), form_n, and root, where following the forms ends.

    Null and empty texts have no words, a null doc_id is hashed as empty text, repeated rows count
    each, texts and words of any length are taken whole; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    counted = word_table(docs, least_length, least_count, every)
    # numbers by falling count, then word: of several near words the smallest number is the best
    words = materialize(with_place(counted, F.desc("n"), F.col("word"), place="id", land=materialize), "words")
    pairs = node_pairs(words)
    near = neighbours(pairs)
    named = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    joined = words.join(near, "id", "left").join(named, "best", "left")
    is_form = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    keep = lambda c: F.when(is_form, F.col(c)).alias(c)
    formed = materialize(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), keep("best"), keep("form"), keep("form_n")), "formed")
    roots = last_forms(formed.where("best is not null").select("id", F.col("best").alias("form")))
    ends = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = formed.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    drop_tables(spark, pairs)
    return out
