"""Toxicity by the nearest labelled examples (operator 7).

Terms are words and the openings of long words. All terms of a text weigh in its
TF-IDF vector, by document frequencies over all documents. Every labelled row of the sample,
of both labels, stands in a block-max inverted index; the nearest ones by cosine are exact.
Their votes, weighted by distance, are calibrated on the examples themselves, each left
out in turn, beside those of the nearest by the telling terms alone, which toxic rows hold
more often than chance allows, and the count of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import shingles
from sessionloom.llm.common import crc_bucket, id_and_text, materialize

#: Words are runs of ASCII letters and bytes beyond ASCII.
GAP = np.ones(256, bool)
GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes of a longer word's opening that are a term too.
OPENING = 5
#: Share of the examples from which a term counts as common: there, adding up dense blocks costs as much as postings do.
COMMON = 1 / 16
#: Examples in a block of the index.
BLOCK = 128
#: Terms that no example holds share so many buckets.
OTHERS = 1 << 20
#: What single precision may be off in a cosine.
ROOM = 1e-4
#: Compression of packed vectors.
CODEC = "zstd"
#: Examples whose cosines are computed at once.
ROWS = 128
#: Texts that are searched for at once.
BATCH = 256
#: Bytes of text that are cut into terms at once.
CHUNK = 2_000_000


def text_terms(column: pa.Array):
    """(rows from, to, text number, hash, count) of the distinct terms of runs of whole texts, by text and hash."""
    for at, to, data, starts in shingles.text_chunks(column, CHUNK):
        text, hashes = shingles.words(data, starts, GAP, OPENING)
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        places = np.flatnonzero(first)
        yield at, to, text[places], hashes[places], np.diff(np.append(places, len(text)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable, bound: int, seed: int) -> DataFrame:
    """Texts of at most ``bound`` labelled rows, by hash order: doc_id, text and label."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    some = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``bound`` ids


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, other): in how many rows of either label each hashed term stands."""

    def count(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for at, to, text, hashes, _ in text_terms(batch.column(0)):
                terms, place = np.unique(hashes, return_inverse=True)
                toxic = np.bincount(place, labels[at:to][text], len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(toxic), pa.array(np.bincount(place, minlength=len(terms)) - toxic)], ["term", "toxic", "other"])

    counted = rows.select("text", "label").mapInArrow(count, "term long, toxic long, other long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def telling_terms(toxic: np.ndarray, other: np.ndarray, rows: np.ndarray, size: int, least_rows: int = 3, least_z: float = 3.0) -> np.ndarray:
    """At most ``size`` terms that toxic rows hold more often than chance allows, by their z score, as a mask; ``rows`` has how many rows of each label there are."""
    out, rate = np.zeros(len(toxic), bool), rows[1] / max(1, rows.sum())
    n = toxic + other
    z = (toxic - rate * n) / np.sqrt(rate * (1 - rate) * n + 1e-9)
    z[toxic < least_rows] = 0
    best = np.argsort(-z, kind="stable")[:size]
    out[best[z[best] > least_z]] = True
    return out


class Terms:
    """Numbers of terms: those of the examples, frequent ones first, then the buckets of all others."""

    def __init__(self, hashes: np.ndarray, frequency: np.ndarray):
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int32)
        rank[np.lexsort((hashes, -frequency))] = np.arange(len(hashes), dtype=np.int32)
        self.sorted, self.rank = hashes[order], rank[order]
        self.size, self.starts = len(hashes), None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = self.size + (hashes % np.uint64(OTHERS)).astype(np.int64)
        if not self.size:
            return out
        if self.starts is None:  # where the hashes that begin alike stand; made by each worker for itself
            self.starts = np.searchsorted(self.sorted, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
            self.starts = np.append(self.starts, np.int32(self.size))
        group = (hashes >> np.uint64(44)).astype(np.int64)
        at, end, left = self.starts[group], self.starts[group + 1], np.arange(len(hashes))
        while len(left):
            open_ = at < end
            left, at, end = left[open_], at[open_], end[open_]
            same = self.sorted[at] == hashes[left]
            out[left[same]] = self.rank[at[same]]
            left, at, end = left[~same], at[~same] + 1, end[~same]
        return out

    def vectors(self, column: pa.Array):
        """(rows from, to, sizes, terms, counts) of runs of texts; terms rise within a text, each once."""
        for at, to, data, starts in shingles.text_chunks(column, CHUNK):
            text, hashes = shingles.words(data, starts, GAP, OPENING)
            key = text * (self.size + OTHERS) + self.numbers(hashes)
            key.sort()
            places = np.flatnonzero(np.diff(key, prepend=-1))
            text, terms = np.divmod(key[places], self.size + OTHERS)
            yield at, to, np.bincount(text, minlength=to - at), terms, np.diff(np.append(places, len(key)))


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples: postings by rare term, and blocks of common terms with each block's largest weights.

    A query adds up the postings of its rare terms. That and the largest weights
    of its common terms bound what any example of a block can reach; blocks whose
    bound is below the k-th best so far are skipped. The search is in single precision
    with room for its error; the cosines of what it leaves are then computed in double precision from the
    examples' own vectors.
    """

    def __init__(self, size: int, frequency: np.ndarray, parts, order: np.ndarray | None = None):
        """``parts`` gives (first row, sizes, terms, weights) of runs of examples, any number of times; ``frequency`` in how many examples each term stands; ``order`` their order among equals."""
        self.order = np.arange(size) if order is None else order
        self.size, self.blocks = size, -(-size // BLOCK)
        common = np.flatnonzero(frequency > size * COMMON)
        self.place = np.full(len(frequency), -1, np.int32)
        self.place[common] = np.arange(len(common))
        own = np.where(self.place >= 0, 0, frequency)
        self.begin = np.concatenate([[0], np.cumsum(own)])
        self.postings = np.zeros((self.begin[-1], 2), np.int32)  # example, and its weight's bits: both come with one read
        weight_of = self.postings[:, 1].view(np.float32)
        self.table = np.zeros((self.blocks, BLOCK, len(common)), np.float32)
        filled = self.begin[:-1].copy()
        self.starts = np.zeros(size + 1, np.int64)
        self.terms, self.exact = np.zeros(int(frequency.sum()), np.int32), np.zeros(int(frequency.sum()))
        for first, sizes, terms, weights in parts:
            at = self.starts[first]
            self.starts[first + 1 : first + len(sizes) + 1] = at + np.cumsum(sizes)
            self.terms[at : at + len(terms)], self.exact[at : at + len(terms)] = terms, weights
            row = first + np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(terms, kind="stable")
            row, terms, weights = row[order], terms[order], weights[order]
            rare = self.place[terms] < 0
            at = row[~rare]
            self.table[at // BLOCK, at % BLOCK, self.place[terms[~rare]]] = weights[~rare]
            row, terms, weights = row[rare], terms[rare], weights[rare]
            group = np.flatnonzero(np.diff(terms, prepend=-1))
            many = np.diff(np.append(group, len(terms)))
            where = filled[terms] + np.arange(len(terms)) - np.repeat(group, many)
            self.postings[where, 0], weight_of[where] = row, weights
            filled[terms[group]] += many
        self.most = self.table.max(1).T if self.blocks else np.zeros((len(common), 0))

    def cosines(self, found: np.ndarray, query: np.ndarray) -> np.ndarray:
        """In double precision, of examples that hold some term with a query whose weights stand at its terms' numbers."""
        out = np.zeros(len(found))
        for at in range(0, len(found), ROWS):
            begin, end = self.starts[found[at : at + ROWS]], self.starts[found[at : at + ROWS] + 1]
            rows = list(zip(begin.tolist(), end.tolist(), strict=True))
            own = query.take(np.concatenate([self.terms[x:y] for x, y in rows]))
            own *= np.concatenate([self.exact[x:y] for x, y in rows])
            out[at : at + ROWS] = np.add.reduceat(own, np.cumsum(end - begin) - (end - begin))
        return out

    def nearest(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """For each query the ``k`` examples of largest cosine, ties to the earlier one, and the share of blocks that were scored; places with cosine 0 are empty.

        Terms from the end of the index on, which no example holds, bring nothing.
        """
        n, width = len(sizes), self.blocks * BLOCK
        ids, best = np.zeros((n, k), np.int64), np.zeros((n, k))
        if not n or not self.size:
            return ids, best, 0.0
        owner = np.repeat(np.arange(n), sizes)
        known = terms < len(self.place)
        owner, terms, weights = owner[known], terms[known], weights[known]
        whole = (np.searchsorted(owner, np.arange(n + 1)), terms, weights)
        place = self.place[terms]
        queries = np.zeros((n, len(self.most)), np.float32)
        queries[owner[place >= 0], place[place >= 0]] = weights[place >= 0]
        rare = place < 0
        owner, terms, weights = owner[rare], terms[rare], weights[rare].astype(np.float32)
        ends = np.searchsorted(owner, np.arange(n + 1))
        scores = np.zeros((n, width), np.float32)
        begin, end = self.begin[terms], self.begin[terms + 1]
        size, begin, end = end - begin, begin.tolist(), end.tolist()
        both = self.postings.view(np.int64)[:, 0]
        for i in range(n):
            a, b = ends[i], ends[i + 1]
            if a < b:
                flat = np.concatenate([both[x:y] for x, y in zip(begin[a:b], end[a:b], strict=True)])
                own = flat.view(np.float32)[1::2] * np.repeat(weights[a:b], size[a:b])
                np.add.at(scores[i], flat.view(np.int32)[::2].astype(np.intp), own)
        if without is not None:
            scores[np.arange(n), without] = -np.inf
        blocks = scores.reshape(n, self.blocks, BLOCK)
        bound = blocks.max(2) + queries @ self.most
        some = min(4 + self.blocks // 16, self.blocks)
        first = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        open_ = np.zeros((n, self.blocks), bool)  # first the blocks that promise most, then what they leave
        np.put_along_axis(open_, first, True, 1)
        kth = np.zeros(n)
        done = np.zeros((n, self.blocks), bool)
        for _ in range(2):
            for b in np.flatnonzero(open_.any(0)):
                asked = np.flatnonzero(open_[:, b])
                blocks[asked, b] += queries[asked] @ self.table[b].T
            done |= open_
            if not kth.any() and first.shape[1] * BLOCK >= k:  # the k-th best of those blocks is no more than the k-th best of all
                kth = np.maximum(np.partition(blocks[np.arange(n)[:, None], first].reshape(n, -1), -k, axis=1)[:, -k], 0)
            open_ = (bound >= kth[:, None] - ROOM) & ~done
        query = np.zeros(len(self.place))
        least = np.maximum(kth - ROOM, np.finfo(np.float32).tiny).astype(np.float32)
        for i in range(n):
            found = np.flatnonzero(scores[i] >= least[i])
            if len(found) > k:  # as the k-th best of the first blocks is a low bound
                own = scores[i, found]
                found = found[own >= np.partition(own, -k)[-k] - ROOM]
            if not len(found):
                continue
            at = slice(whole[0][i], whole[0][i + 1])
            query[whole[1][at]] = whole[2][at]
            cosine = self.cosines(found, query)
            query[whole[1][at]] = 0
            top = np.lexsort((self.order[found], -np.round(cosine, 12)))[:k]
            ids[i, : len(top)], best[i, : len(top)] = found[top], cosine[top]
        return ids, np.minimum(best, 1.0), float(done.mean())


def unit_vectors(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights (1 + log count) * idf of vectors that stand one after the other, each of length 1."""
    raw = (1 + np.log(np.maximum(counts, 1))) * idf[terms]
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), raw * raw, len(sizes)))
    return raw / np.repeat(length, sizes)


def votes(cosines: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Share of toxic neighbours, each weighted by the inverse of its distance; 0 without neighbours."""
    weight = np.where(cosines > 0, 1 / (np.sqrt(np.maximum(2 - 2 * cosines, 0)) + 0.1), 0)
    return (weight * toxic).sum(1) / np.maximum(weight.sum(1), 1e-12)


def logistic(features: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with intercept in the last place, by Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(vote: np.ndarray, telling: np.ndarray, hits: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """What a score is calibrated from: the vote, that by telling terms alone, and how many of those the text holds."""
    return np.stack([vote, vote * vote, telling, telling * telling, np.log1p(hits), telling * np.log1p(hits), telling * distinct], axis=1)


def only(which: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and counts of vectors that stand one after the other, of the terms in ``which`` alone."""
    some = which[terms]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes)), terms[some], counts[some]


def packed(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Of each vector its size, and its rising terms by their differences, and counts, as planes of bytes: a fraction of the lists' size."""
    codec, ends, out = pa.Codec(CODEC), np.cumsum(sizes), []
    steps = np.diff(terms, prepend=0)
    first = (ends - sizes)[sizes > 0]
    steps[first] = terms[first]
    planes = [(x >> shift).astype(np.uint8).tobytes() for x in (steps, counts) for shift in (0, 8, 16, 24)]
    at = 0
    for end in ends.tolist():
        row = b"".join([plane[at:end] for plane in planes])
        out.append((end - at).to_bytes(4, "little") + codec.compress(row, asbytes=True) if row else b"")
        at = end
    return out


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, terms and counts of vectors, one after the other."""
    codec, many = pa.Codec(CODEC), [int.from_bytes(row[:4], "little") for row in rows]
    held = [codec.decompress(row[4:], 8 * n, asbytes=True) if n else b"" for row, n in zip(rows, many, strict=True)]

    def values(first: int) -> np.ndarray:
        out = np.zeros(sum(many), np.int64)
        for k in range(4):
            plane = np.frombuffer(b"".join([row[(first + k) * n : (first + k + 1) * n] for row, n in zip(held, many, strict=True)]), np.uint8)
            if plane.any():
                out += plane.astype(np.int64) << (8 * k)
        return out

    sizes, sums = np.array(many, np.int64), np.append(0, np.cumsum(values(0)))
    return sizes, sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes), values(4)


def alike_together(held: list[bytes], idf: np.ndarray, size: int, groups: int = 24, rounds: int = 6) -> np.ndarray:
    """An order of the examples in which those with the same common terms stand together, so that blocks differ in what they can reach."""
    frequency = np.zeros(size, np.int64)
    for at in range(0, len(held), 512):
        frequency += np.bincount(unpacked(held[at : at + 512])[1], minlength=size)
    common = np.flatnonzero(frequency > len(held) * COMMON)
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    rows = np.zeros((len(held), len(common)), np.float32)
    for at in range(0, len(held), 512):
        sizes, terms, counts = only(place >= 0, *unpacked(held[at : at + 512]))
        rows[at + np.repeat(np.arange(len(sizes)), sizes), place[terms]] = unit_vectors(sizes, terms, counts, idf)
    centers = rows[:: max(1, len(rows) // groups)][:groups].copy()
    nearest = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        nearest = (rows @ centers.T - (centers * centers).sum(1) / 2).argmax(1)
        for g in range(len(centers)):
            if (nearest == g).any():
                centers[g] = rows[nearest == g].mean(0)
    return np.argsort(nearest, kind="stable")


class Examples:
    """The labelled vectors, packed as they are sent to the workers; each makes its indexes once."""

    def __init__(self, held: list[bytes], frequency: np.ndarray, idf: np.ndarray, telling: np.ndarray, toxic: np.ndarray, order: np.ndarray):
        """``frequency`` has in how many of the examples each of their terms stands."""
        self.order, self.frequency = order, frequency
        self.held, self.idf, self.telling, self.toxic, self.made = held, idf, telling, toxic, None

    def index(self, which: np.ndarray | None) -> BlockMaxIndex:
        frequency = self.frequency if which is None else np.where(which[: len(self.frequency)], self.frequency, 0)

        def parts():
            for at in range(0, len(self.held), 512):
                sizes, terms, counts = unpacked(self.held[at : at + 512])
                if which is not None:
                    sizes, terms, counts = only(which, sizes, terms, counts)
                yield at, sizes, terms, unit_vectors(sizes, terms, counts, self.idf)

        return BlockMaxIndex(len(self.held), frequency, parts(), self.order)

    def search(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Nearest examples and their cosines; vote by telling terms, their places and number, of each vector."""
        if self.made is None:
            self.made = self.index(None), self.index(self.telling)
        ids, cosines, _ = self.made[0].nearest(sizes, terms, unit_vectors(sizes, terms, counts, self.idf), k, without)
        distinct, terms, counts = only(self.telling, sizes, terms, counts)
        hits = np.bincount(np.repeat(np.arange(len(sizes)), distinct), counts, len(sizes)).astype(np.int64)
        near, close, _ = self.made[1].nearest(distinct, terms, unit_vectors(distinct, terms, counts, self.idf), k, without)
        return ids, cosines, votes(close, self.toxic[near]), hits, distinct

    def searched(self, held: pa.Array, k: int):
        """search() for all packed vectors of a column, BATCH at a time."""
        for at in range(0, len(held), BATCH):
            yield self.search(*unpacked(held.slice(at, BATCH).to_pylist()), k)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, fit_rows: int = 20_000, terms_kept: int = 4_096, k: int = 15, seed: int = 3
) -> DataFrame:
    """Score every whole text for toxicity.

    Rows whose crc32(doc_id as text) modulo ``folds`` is 0 are held out. Fitted
    on at most ``fit_rows`` labelled rows of the others, all of which stand in
    the index. Returns doc_id, held_out, score, predicted, n_terms (places of
    the ``terms_kept`` terms that toxic rows hold most above chance), and the
    evidence: doc_ids, cosines and labels of the nearest examples.

    Terms are known by 64-bit hashes. Those that no example holds count in a
    text's length alone; they share buckets, each with the document frequency of all that fall there.

    Null and empty texts and texts that share no term with an example have no
    neighbours and get the rate of toxic rows among labelled rows of that kind.
    Texts of any length are read whole. Equal cosines go to the smaller doc_id.
    Without usable labels every score is 0. Repeated rows score alike; null doc_ids are
    kept (crc32 of empty text); of repeated labels the larger counts, of texts of one
    labelled doc_id the least; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = labelled(docs, labels, "toxic", crc_bucket(F.col("doc_id"), folds) != 0, fit_rows, seed)
    rows = materialize(rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "label").agg(F.min("text").alias("text")), "labelled")
    read = id_and_text(docs)
    held_out = (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out")
    evidence_kind = "array<struct<doc_id:bigint,cosine:double,toxic:int>>"
    of_label = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not of_label:
        return read.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).cast("long").alias("n_terms"), F.expr(f"cast(array() as {evidence_kind})").alias("evidence"))

    counts = term_counts(rows).toArrow()  # one row a term of the sample, as of all that comes to the driver
    hashes, in_toxic, in_other = counts.column(0).to_numpy().view(np.uint64), counts.column(1).to_numpy(), counts.column(2).to_numpy()
    terms = Terms(hashes, in_toxic + in_other)
    telling = np.zeros(terms.size + OTHERS, bool)
    telling[terms.numbers(hashes)] = telling_terms(in_toxic, in_other, np.array([of_label.get(0, 0), of_label.get(1, 0)]), terms_kept)
    shared = spark.sparkContext.broadcast(terms)

    def pack(batches):
        for batch in batches:
            for at, to, sizes, found, n in shared.value.vectors(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(packed(sizes, found, n), pa.binary())], ["doc_id", "held"])

    # a text's vector is a fraction of it: texts are cut into terms once, for the frequencies and for the search
    vectors = materialize(read.mapInArrow(pack, "doc_id long, held binary"), "vectors")

    def documents(batches):
        total = np.zeros(shared.value.size + OTHERS + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                np.add.at(total, unpacked(batch.column(0).slice(at, 512).to_pylist())[1], 1)
            total[-1] += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["t", "n"])

    of_term = vectors.select("held").mapInArrow(documents, "t long, n long").groupBy("t").agg(F.sum("n")).toArrow()
    frequency = np.zeros(terms.size + OTHERS + 1)
    frequency[of_term.column(0).to_numpy()] = of_term.column(1).to_numpy()
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    sample = rows.select("doc_id", "text").mapInArrow(pack, "doc_id long, held binary").join(F.broadcast(rows.select("doc_id", "label")), "doc_id").toArrow().sort_by("doc_id").combine_chunks()
    ids, toxic = sample.column("doc_id").to_numpy(), sample.column("label").to_numpy().astype(float)
    held = sample.column("held").to_pylist()
    together = alike_together(held, idf, terms.size)
    ids, toxic = ids[together], toxic[together]
    in_examples = np.zeros(terms.size, np.int64)
    in_examples[terms.numbers(hashes)] = in_toxic + in_other
    examples = spark.sparkContext.broadcast(Examples([held[i] for i in together], in_examples, idf, telling, toxic, np.argsort(np.argsort(ids))))

    def leave_out(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                own = batch.column(0).slice(at, BATCH)
                near, cosines, *others = examples.value.search(*unpacked([examples.value.held[i] for i in own.to_pylist()]), k, own.to_numpy())
                columns = [pa.array(list(near), pa.list_(pa.int64())), pa.array(list(cosines), pa.list_(pa.float64())), *map(pa.array, others)]
                yield pa.RecordBatch.from_arrays([own, *columns], ["own", "near", "cosines", "vote", "hits", "distinct"])

    kinds = "own long, near array<long>, cosines array<double>, vote double, hits long, distinct long"
    tried = spark.range(0, len(ids), 1, 48).mapInArrow(leave_out, kinds).toArrow().combine_chunks()
    y = toxic[tried.column(0).to_numpy()]
    near, cosines = (tried.column(i).combine_chunks().flatten().to_numpy().reshape(len(y), k) for i in (1, 2))
    alone = cosines[:, 0] == 0
    base = (y[alone].sum() + 0.1) / (alone.sum() + 10)
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)  # where the examples are of one label
    weights = None
    if 0 < y[~alone].sum() < (~alone).sum():
        x = evidence(votes(cosines, toxic[near]), *(tried.column(i).to_numpy() for i in (3, 4, 5)))
        weights = logistic(x[~alone], y[~alone])

    def score(batches):
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            done = 0
            for near, cosines, vote, hits, distinct in examples.value.searched(batch.column(1), k):
                x = evidence(votes(cosines, toxic[near]), vote, hits, distinct)
                scores = np.full(len(x), rate) if weights is None else 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                found = cosines > 0
                scores[~found.any(1)] = base
                near, sizes = near[found], found.sum(1)
                items = pa.StructArray.from_arrays([pa.array(ids[near]), pa.array(cosines[found]), pa.array(toxic[near].astype(np.int32))], ["doc_id", "cosine", "toxic"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(x)), pa.array(scores), pa.array(hits), lists], ["doc_id", "score", "n_terms", "evidence"])
                done += len(x)

    scored = vectors.mapInArrow(score, f"doc_id long, score double, n_terms long, evidence {evidence_kind}")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms", "evidence")
