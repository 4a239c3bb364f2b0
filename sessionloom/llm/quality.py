"""Quality classifier by co-training (operator 6).

Two views of a document: its text (the words and pairs of words that stand in it, and
what it is like as a text) and its metadata (source and language). A classifier
on each view labels the rows it is sure of for the other one, over several
rounds in which every row takes part; then both are calibrated on labelled rows that
neither was fitted on, and combined to score all documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import shingles
from sessionloom.llm.common import bound_batches, drop_tables, free_names, materialize
from sessionloom.llm.toxicity import logistic

#: ASCII marks whose share of a text is a feature each.
MARKS = b"!#$%&*|.,?-_<>{}"
#: Kinds of bytes: capital, small letter, digit, beyond ASCII, line end, other blank, other, and the marks.
KIND = np.full(256, 6, np.int64)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 0, 1, 2, 3
KIND[shingles.BLANK] = 5
KIND[10] = 4
KIND[list(MARKS)] = 7 + np.arange(len(MARKS))
KINDS = 7 + len(MARKS)
#: Buckets of hashed words, and of hashed pairs of words.
BUCKETS = 1 << 17
#: Buckets of hashed sources, of languages, and of both together.
SLOTS = 1 << 14


def repeats(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of items equal to the one before, and the share of items seen before."""
    count = np.maximum(np.bincount(text, minlength=n), 1)
    same = (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    seen = (t[1:] == t[:-1]) & (h[1:] == h[:-1])
    return np.bincount(text[1:][same], minlength=n) / count, np.bincount(t[1:][seen], minlength=n) / count


def runs_of(text: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words within a text."""
    many = max(0, len(hashes) - size + 1)
    rolled = sum(hashes[k : many + k] * shingles.ODD[k] for k in range(size))
    whole = text[size - 1 :] == text[:many] if many else np.zeros(0, bool)
    return text[:many][whole], rolled[whole] if many else rolled


def buckets(text: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of each word and of each pair of words; pairs have buckets of their own."""
    pair = runs_of(text, hashes, 2)
    mask = np.uint64(BUCKETS - 1)
    return [(text, (hashes & mask).astype(np.int64)), (pair[0], (shingles.mix(pair[1]) & mask).astype(np.int64) + BUCKETS)]


def text_view(data: np.ndarray, starts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Features of each whole text: shares of kinds of bytes, word lengths, repetition, and the mean log-odds of its words and pairs."""
    n, size = len(starts), np.diff(np.append(starts, len(data)))
    kinds = np.bincount(np.repeat(np.arange(n) * KINDS, size) + KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    shares = kinds / np.maximum(size, 1)[:, None]
    text, hashes = shingles.words(data, starts)
    count = np.bincount(text, minlength=n)
    columns = [np.log1p(count), np.minimum(size / np.maximum(count, 1), 50) / 10, *repeats(text, hashes, n)]
    columns += [repeats(*runs_of(text, hashes, run), n)[1] for run in (2, 4)]
    shape = np.concatenate([shares, np.stack(columns, axis=1)], axis=1)
    content = [np.bincount(t, odds[b], n) / np.maximum(np.bincount(t, minlength=n), 1) for t, b in buckets(text, hashes)]
    return np.concatenate([shape, np.sqrt(shape), np.stack(content, axis=1)], axis=1).astype(np.float32)


def metadata_view(source: list, lang: list) -> np.ndarray:
    """Hashed slots of source, of language and of both, null ones apart."""
    slot = lambda *x: zlib.crc32(repr(x).encode()) % SLOTS
    memo: dict = {}
    return np.array([memo.get(x) or memo.setdefault(x, (slot(0, x[0]), SLOTS + slot(1, x[1]), 2 * SLOTS + slot(2, *x))) for x in zip(source, lang, strict=True)], np.int32).reshape(-1, 3)


def views(rows: DataFrame, odds: np.ndarray, others: list[str] = ()) -> DataFrame:
    """(others, text array<float>, meta array<int>) of rows with text, source and lang."""

    def found(batches):
        for batch in batches:
            for at, to, data, starts in shingles.text_chunks(batch.column(0)):
                part = batch.slice(at, to - at)
                text, meta = text_view(data, starts, odds), metadata_view(part.column(1).to_pylist(), part.column(2).to_pylist())
                as_lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((text, pa.float32()), (meta, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[3:], *as_lists], [*others, "text", "meta"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*others).schema) if others else ""
    return rows.select("text", "source", "lang", *others).mapInArrow(found, f"{kinds}text array<float>, meta array<int>")


def log_odds(good: np.ndarray, bad: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Smoothed log-odds of good by item, against those of all items; 0 for items never seen."""
    total = np.log((good.sum() + least) / (bad.sum() + least))
    rate = (good.sum() + least) / (good.sum() + bad.sum() + 2 * least)
    return np.log((good + 2 * least * rate) / (bad + 2 * least * (1 - rate))) - total


@dataclass
class Text:
    """A standardised logistic classifier of the text view."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Text:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        return Text(mean, scale, logistic(np.clip((x - mean) / scale, -8, 8), y))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -12, 12)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and Hessian at the weights, one after the other."""
        x = self.design(x)
        p = sigmoid(np.clip(x @ self.weights, -30, 30))
        return np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

    def step(self, sums: np.ndarray, ridge: float = 1.0) -> Text:
        n = len(self.weights)
        penalty = np.full(n, ridge)
        penalty[-1] = 1e-6
        move = np.linalg.solve(sums[n:].reshape(n, n) + np.diag(penalty), sums[:n] + penalty * self.weights)
        return Text(self.mean, self.scale, self.weights - np.clip(move, -2, 2))


@dataclass
class Metadata:
    """A naive Bayes classifier of the metadata view: log-odds by slot, from counts of good and bad rows."""

    counts: np.ndarray  # (2, slots): bad, good

    def logit(self, meta: np.ndarray) -> np.ndarray:
        thirds = [log_odds(*part) for part in zip(np.split(self.counts[1], 3), np.split(self.counts[0], 3), strict=True)]
        n = self.counts.sum(1) / 3
        return np.clip(np.concatenate(thirds)[meta].mean(1) + np.log((n[1] + 1) / (n[0] + 1)), -12, 12)

    @staticmethod
    def count(meta: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(meta[y == label].ravel(), minlength=3 * SLOTS) for label in (0, 1)]).astype(float)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def exchange(features: DataFrame, text: Text, meta: Metadata, sure: float) -> tuple[np.ndarray, np.ndarray, float]:
    """What all rows say to the other view: counts by slot from the text's sure labels, sums for the text from the metadata's.

    Every row is scored by both classifiers. The driver gets one row for each slot and each
    entry of the sums, however many rows there are.
    """
    width = len(text.weights)

    def say(batches):
        counts, sums, many = np.zeros((2, 3 * SLOTS)), np.zeros(width + width * width), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (0, 1))
            p = sigmoid(text.logit(x))
            told = (p >= sure) | (p <= 1 - sure)
            counts += Metadata.count(m[told], (p[told] >= sure).astype(int))
            p = sigmoid(meta.logit(m))
            told = (p >= sure) | (p <= 1 - sure)
            sums += text.sums(x[told], (p[told] >= sure).astype(float))
            many += int(told.sum())
        flat = np.concatenate([counts.ravel(), sums, [many]])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["place", "value"])

    said = features.select("text", "meta").mapInArrow(say, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(6 * SLOTS + width + width * width + 1)
    flat[said.column(0).to_numpy()] = said.column(1).to_numpy()
    return flat[: 6 * SLOTS].reshape(2, -1), flat[6 * SLOTS : -1], flat[-1]


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, rounds: int = 4, sure: float = 0.97, seed: int = 17) -> DataFrame:
    """Score every whole text for quality.

    Fitted on at most ``fit_rows`` labelled rows, taken by hash order: a third
    gives the log-odds of words, a third the first classifiers, a third the
    calibration. All other rows take part in every round by their pseudo-labels,
    which together weigh as much as the labelled rows at most. Only features of labelled rows
    and sums come to the driver. Returns all columns of ``docs`` with
    quality_score (the probability of a good document), text_score and
    metadata_score (either view's own, calibrated); where ``docs`` has a column of such
    a name, the new one has "_" after it.

    Null and empty texts have all-zero text features but for the words they lack; null sources and
    languages are values of their own. Texts of any length are read whole, in
    runs of whole texts. Repeated rows score alike; of a repeated labelled doc_id one row is
    fitted on, and of repeated labels the larger counts; null doc_ids are kept. Equal
    scores are ties and stay so. With labels of one class or none every score is
    that class's, or 1. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    new = free_names(["quality_score", "text_score", "metadata_score"], docs.columns)
    read = docs.select("doc_id", "text", "source", "lang")
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    ids = materialize(ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows), "labels")
    fitted = F.broadcast(ids)  # fit_rows at most
    known = read.join(fitted, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "source", "lang")).alias("row"))
    known = materialize(known.select("label", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(3)).cast("int").alias("part"), "row.*"), "known")
    classes = {(r.part, r.label): r["count"] for r in known.groupBy("part", "label").count().collect()}
    if not all(any((p, label) in classes for p in range(3)) for label in (0, 1)):
        only = F.lit(float(next(iter(classes))[1]) if classes else 1.0)
        return docs.select("*", *[only.alias(c) for c in new])
    apart = len(classes) == 6  # else all labelled rows serve for everything
    in_part = lambda p: F.col("part") == p if apart else F.lit(True)

    def words(batches):
        counts = np.zeros((2, 2 * BUCKETS))
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for at, to, data, starts in shingles.text_chunks(batch.column(0)):
                for t, b in buckets(*shingles.words(data, starts)):
                    pairs = np.unique(t * 2 * BUCKETS + b)  # in how many texts
                    np.add.at(counts, (labels[at:to][pairs // (2 * BUCKETS)], pairs % (2 * BUCKETS)), 1)
        used = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "bad", "good"])

    told = known.where(in_part(0)).select("text", "label").mapInArrow(words, "bucket long, bad double, good double")
    told = told.groupBy("bucket").agg(F.sum("bad"), F.sum("good")).toArrow()  # one row a bucket
    counts = np.zeros((2, 2 * BUCKETS))
    counts[:, told.column(0).to_numpy()] = told.column(1).to_numpy(), told.column(2).to_numpy()
    odds = log_odds(counts[1], counts[0]).astype(np.float32)

    sample = views(known.where(~in_part(0) | F.lit(not apart)), odds, ["label", "part"]).toArrow().combine_chunks()
    y, part = sample.column(0).to_numpy().astype(float), sample.column(1).to_numpy()
    x, m = (sample.column(i).combine_chunks().flatten().to_numpy().reshape(len(y), -1) for i in (2, 3))
    order = np.lexsort((*x.T[:8], y))  # however the rows came
    y, part, x, m = y[order], part[order], x[order], m[order]
    fit, held = (part == 1, part == 2) if apart else (np.ones(len(y), bool),) * 2
    text, own = Text.fit(x[fit], y[fit]), Metadata.count(m[fit], y[fit].astype(int))
    meta = Metadata(own)
    features = materialize(views(read.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti"), odds), "features")
    for _ in range(rounds):
        counted, sums, many = exchange(features, text, meta, sure)
        weight = min(1.0, fit.sum() / max(1.0, counted.sum() / 3))
        stepped = text.step(text.sums(x[fit], y[fit]) + min(1.0, fit.sum() / max(1.0, many)) * sums)
        text, meta = stepped, Metadata(own + weight * counted)
    drop_tables(docs.sparkSession, features, known)
    logits = np.stack([text.logit(x[held]), meta.logit(m[held])], axis=1)
    combined, *calibrated = logistic(logits, y[held]), *(logistic(logits[:, [k]], y[held]) for k in (0, 1))

    @F.arrow_udf("struct<quality_score double, text_score double, metadata_score double>")
    def score(text_column: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        found = [np.zeros((0, 3))]
        for at, to, data, starts in shingles.text_chunks(text_column):
            slots = metadata_view(source.slice(at, to - at).to_pylist(), lang.slice(at, to - at).to_pylist())
            z = np.stack([text.logit(text_view(data, starts, odds)), meta.logit(slots)], axis=1)
            found.append(np.stack([sigmoid(z @ combined[:-1] + combined[-1]), *(sigmoid(z[:, k] * w[0] + w[1]) for k, w in enumerate(calibrated))], axis=1))
        scores = np.concatenate(found)
        return pa.StructArray.from_arrays([pa.array(scores[:, k]) for k in range(3)], ["quality_score", "text_score", "metadata_score"])

    # the text goes to Python and doesn't come back
    inner = free_names(["scores"], docs.columns)[0]
    scored = docs.withColumn(inner, score("text", "source", "lang"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{inner}.{c}").alias(n) for c, n in zip(("quality_score", "text_score", "metadata_score"), new, strict=True)])
