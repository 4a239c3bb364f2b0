"""Secrets in texts (operator 12).

Forms that tell themselves (assignments, access keys, long hexadecimal runs) are
found by pattern. Other secrets are runs of an encoding's characters that look
drawn at random. A battery of tests measures that twice: a run has to agree with
uniform random characters in chi-squared, runs and serial correlation, and to
disagree in the same three ways with how this corpus writes its ordinary words,
whose characters and neighbouring characters are counted over all documents. The latter gives a p-value, and
within each encoding and class of length a false-discovery rate holds for what is called a secret.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm import runs
from sessionloom.llm.common import id_and_text, materialize
from sessionloom.llm.shingles import LOWER

KINDS = ("assign", "access", "hex", "random")
#: Patterns of bytes, so that case is that of ASCII letters alone.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: What every assignment holds one of, in lower case.
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHARACTERS = DIGITS + SMALL + LARGE + "+/-_"
#: Encodings from the narrowest on, each with its characters in the order of their values.
ENCODINGS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": LARGE + "234567", "base36": DIGITS + SMALL,
    "base62": DIGITS + LARGE + SMALL, "base64": LARGE + SMALL + DIGITS + "+/", "base64url": LARGE + SMALL + DIGITS + "-_",
}
N = len(CHARACTERS)
CODE = np.full(256, N, np.int64)
CODE[[ord(c) for c in CHARACTERS]] = np.arange(N)
#: Kind of a character: digit, small, large, sign.
SORT = np.array([0] * 10 + [1] * 26 + [2] * 26 + [3] * 4 + [4])
KINDS_OF = (SORT[:N, None] == np.arange(4)).astype(float)
MEMBER = np.array([[c in own for c in CHARACTERS] for own in ENCODINGS.values()])
#: A character's value in an encoding, centred and scaled to unit variance of a uniform draw.
VALUE = np.zeros((len(ENCODINGS), N))
for _i, _own in enumerate(ENCODINGS.values()):
    _k = len(_own)
    VALUE[_i, [CHARACTERS.index(c) for c in _own]] = (np.arange(_k) - (_k - 1) / 2) / math.sqrt((_k * _k - 1) / 12)
HEX, PLAIN, PATH = (np.isin(np.arange(256), [ord(c) for c in s]) for s in (DIGITS + "abcdef", DIGITS + SMALL + LARGE + "+/", DIGITS + SMALL + LARGE + "-_"))
#: p-values are counted in steps of so many to the power of ten, down to 10 to the minus LOWEST / STEPS.
STEPS, LOWEST = 16, 4800


def long_runs(data: np.ndarray, starts: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    begin, end = runs.spans(member[data], starts)
    kept = end - begin >= least
    return begin[kept], end[kept]


def candidate_runs(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of either base-64 alphabet, once each."""
    begin, end = long_runs(data, starts, PLAIN, least)
    others = long_runs(data, starts, PATH, least)
    signs = np.concatenate([[0], np.cumsum((data == 45) | (data == 95))])
    own = signs[others[1]] > signs[others[0]]  # without a sign it is one of the first, or part of one
    return np.concatenate([begin, others[0][own]]), np.concatenate([end, others[1][own]])


def ordinary_pairs(docs: DataFrame, least: int) -> np.ndarray:
    """How often each character follows each other one within the runs shorter than ``least`` of all documents, as a square table."""

    def count(batches):
        total = np.zeros((N + 1) * (N + 1), np.int64)
        for batch in batches:
            for _, _, data, starts in runs.pieces(batch.column(0)):
                codes = CODE[data]
                for begin, end in zip(*candidate_runs(data, starts, least), strict=True):
                    codes[begin:end] = N
                both = codes[:-1] * (N + 1) + codes[1:]
                both[starts[(starts > 0) & (starts < len(data))] - 1] = N * (N + 1) + N
                total += np.bincount(both, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["at", "n"])

    counts = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).toArrow()  # a row a pair of characters at most
    table = np.zeros((N + 1) * (N + 1))
    table[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    return table.reshape(N + 1, N + 1)[:N, :N]


class Ordinary:
    """What the corpus's ordinary writing would give in each encoding: shares of characters, of changes of kind, and dependence of neighbours."""

    def __init__(self, pairs: np.ndarray):
        k = len(ENCODINGS)
        self.s2, self.s3, self.change = np.zeros(k), np.zeros(k), np.zeros(k)
        self.tie, self.mean, self.spread = np.zeros((k, N, N)), np.zeros(k), np.zeros(k)
        for i, own in enumerate(MEMBER):
            at = np.flatnonzero(own)
            seen = pairs[np.ix_(at, at)]
            share = (seen.sum(0) + seen.sum(1) + 1) / (seen.sum(0) + seen.sum(1) + 1).sum()
            joint = (seen + len(at) ** 2 * np.outer(share, share)) / (seen.sum() + len(at) ** 2)
            tie = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
            self.s2[i], self.s3[i] = (share**2).sum(), (share**3).sum()
            self.change[i] = joint[SORT[at][:, None] != SORT[at]].sum()
            self.tie[i][np.ix_(at, at)] = tie
            self.mean[i] = (joint * tie).sum()
            self.spread[i] = math.sqrt(max(1e-12, (joint * tie * tie).sum() - self.mean[i] ** 2))


def log10_tail(z: np.ndarray) -> np.ndarray:
    """log10 of the chance that a normal value lies below z, for z far below 0 by its expansion."""
    out = np.array([math.log10(max(0.5 * math.erfc(-x / math.sqrt(2)), 1e-300)) if x > -35 else (-x * x / 2 - math.log(-x * math.sqrt(2 * math.pi))) / math.log(10) for x in z.tolist()])
    return out.reshape(z.shape)


def normal_of_chi2(chi2: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The normal value as far out as chi2 is, by its cube root."""
    return (np.cbrt(chi2 / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))


def battery(data: np.ndarray, begin: np.ndarray, end: np.ndarray, ordinary: Ordinary, most: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Encoding of each run, or -1, and its level: -log10 of its p-value in steps, rounded down; 0 where it isn't random.

    Against uniform random characters each of four standardised departures may be ``most`` at most: chi-squared of the
    characters' counts and of those of digits, small and large letters, number of runs above and below the middle value, lag-one correlation of values.
    Against ordinary writing there are three p-values: for as few equal characters (chi-squared again), as
    many changes between digits, small and large letters, neighbours as independent. e times their
    geometric mean is a p-value however they depend on each other.
    """
    size = end - begin
    owner = np.repeat(np.arange(len(begin)), size)
    codes = CODE[data[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]]
    counts = np.bincount(owner * N + codes, minlength=len(begin) * N).reshape(-1, N)
    fits = ~((counts > 0) @ ~MEMBER.T)
    encoding = np.where(fits.any(1) & (counts[:, 10:62].sum(1) > 0), fits.argmax(1), -1)
    e, k, n = np.maximum(encoding, 0), MEMBER.sum(1)[np.maximum(encoding, 0)], size.astype(float)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    of, a, b = owner[pair], codes[pair], codes[pair + 1]
    add = lambda w: np.bincount(of, w, len(begin))
    equal = (counts * (counts - 1.0)).sum(1) / 2
    # uniform random characters
    chi2 = k / n * (counts.astype(float) ** 2).sum(1) - n
    z_chi2 = normal_of_chi2(chi2, k - 1)
    share = MEMBER[e] @ KINDS_OF / k[:, None]
    z_kinds = normal_of_chi2(((counts @ KINDS_OF) ** 2 / np.where(share > 0, share, 1)).sum(1) / n - n, (share > 0).sum(1) - 1)
    x, y = VALUE[e[of], a], VALUE[e[of], b]
    z_runs = (2 * add((x > 0) != (y > 0)) - (n - 1)) / np.sqrt(n - 1)
    z_serial = add(x * y) / np.sqrt(n - 1)
    random = (np.abs(z_chi2) <= most) & (z_kinds <= most) & (np.abs(z_runs) <= most) & (np.abs(z_serial) <= most)
    # ordinary writing
    s2, s3 = ordinary.s2[e], ordinary.s3[e]
    pairs = n * (n - 1) / 2
    spread = np.sqrt(np.maximum(pairs * (s2 - s2 * s2) + pairs * 2 * (n - 2) * (s3 - s2 * s2), 1e-12))
    p_equal = log10_tail((equal - pairs * s2) / spread)
    rate, seen = np.clip(ordinary.change[e], 1e-9, 1 - 1e-9), add(SORT[a] != SORT[b]) / (n - 1)
    inner = np.clip(seen, 1e-12, 1 - 1e-12)  # a binomial tail is at most exp(-n * divergence)
    p_change = np.where(seen > rate, -(n - 1) * (inner * np.log(inner / rate) + (1 - inner) * np.log((1 - inner) / (1 - rate))) / math.log(10), 0.0)
    p_tie = log10_tail((add(ordinary.tie[e[of], a, b]) - (n - 1) * ordinary.mean[e]) / (ordinary.spread[e] * np.sqrt(n - 1)))
    level = np.floor(-((p_equal + p_change + p_tie) / 3 + math.log10(math.e)) * STEPS)
    return encoding, np.where(random & (encoding >= 0), np.clip(level, 0, LOWEST), 0).astype(np.int64)


def base_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and kind, by place in KINDS, of the spans that patterns find."""
    found: list[tuple[int, int, int]] = []
    for words, source, pattern, kind in ((WORDS, LOWER[data].tobytes(), ASSIGN, 0), ((b"AKIA",), data.tobytes(), ACCESS, 1)):
        held = set()
        for word in words:
            at = source.find(word)
            while at >= 0:  # from one text that holds it to the next
                text = int(np.searchsorted(starts, at, side="right")) - 1
                held.add(text)
                at = source.find(word, int(starts[text + 1])) if text + 1 < len(starts) else -1
        for text in held:
            low, high = int(starts[text]), int(starts[text + 1]) if text + 1 < len(starts) else len(data)
            for m in pattern.finditer(data[low:high].tobytes()):
                if len(m.group(2)) >= 6 if kind == 0 else m.end() - m.start() >= 20:
                    found.append((low + m.start(), low + m.end(), kind))
    begin, end, kind = np.array(found, np.int64).reshape(-1, 3).T
    more = long_runs(data, starts, HEX, 24)
    return np.concatenate([begin, more[0]]), np.concatenate([end, more[1]]), np.concatenate([kind, np.full(len(more[0]), 2)])


def of_texts(texts: int, owner: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    """A list of structs for each text."""
    order = np.argsort(owner, kind="stable")
    items = pa.StructArray.from_arrays([pa.array(c[order].astype(np.int64)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(texts + 1)), pa.int32()), items)


BASE, RANDOM = "array<struct<start:long,kind:long,end:long>>", "array<struct<start:long,kind:long,end:long,stratum:long,level:long,apart:long>>"


def find_secrets(docs: DataFrame, least: int = 20, rate: float = 0.01) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns for every row doc_id, n_assign, n_access, n_hex, base_sha256 and spans: ``kind:start:end`` in
    characters, by start and kind, comma-joined. Runs of at least ``least`` characters are tested for
    randomness; of those called ``random`` in any encoding and class of length (powers of two) the expected
    share of ordinary ones is ``rate`` at most, by Benjamini and Hochberg over all candidates of all documents. Such
    a span is left out where it meets a span found by pattern.

    Null and empty texts have no spans; texts and runs of any length are taken whole; repeated rows are found
    alike; a null doc_id is kept; equal p-values are kept or dropped together; an empty
    table gives no rows; further columns are ignored.
    """
    read = id_and_text(docs)
    ordinary = Ordinary(ordinary_pairs(read, least))

    def search(batches):
        for batch in batches:
            for at, to, data, starts in runs.pieces(batch.column(1)):
                texts = to - at
                begin, end, kind = base_spans(data, starts)
                own_begin, own_end = candidate_runs(data, starts, least)
                encoding, level = battery(data, own_begin, own_end, ordinary)
                kept = encoding >= 0
                own_begin, own_end, encoding, level = own_begin[kept], own_end[kept], encoding[kept], level[kept]
                # pattern spans that begin before a run's end, less those that end before it begins
                meets = np.searchsorted(np.sort(begin), own_end, side="left") - np.searchsorted(np.sort(end), own_begin, side="right")
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                text_of = lambda x: np.searchsorted(starts, x, side="right") - 1
                place = lambda x, owner: points[x] - points[starts[owner]]
                base_owner, owner = text_of(begin), text_of(own_begin)
                stratum = encoding * 64 + np.floor(np.log2(np.maximum(own_end - own_begin, 1))).astype(np.int64)
                base = of_texts(texts, base_owner, {"start": place(begin, base_owner), "kind": kind, "end": place(end, base_owner)})
                columns = {"start": place(own_begin, owner), "kind": np.full(len(owner), 3), "end": place(own_end, owner), "stratum": stratum, "level": level, "apart": meets == 0}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, texts), base, of_texts(texts, owner, columns)], ["doc_id", "base", "random"])

    found = materialize(read.mapInArrow(search, f"doc_id long, base {BASE}, random {RANDOM}"), "spans")
    levels = found.select(F.explode("random").alias("c")).groupBy("c.stratum", "c.level").agg(F.count("*").alias("n"))
    upward = Window.partitionBy("stratum").orderBy(F.desc("level"))  # as many rows as levels
    passed = levels.withColumns({"tests": F.sum("n").over(Window.partitionBy("stratum")), "claimed": F.sum("n").over(upward)})
    passed = passed.where(F.pow(F.lit(10.0), -F.col("level") / STEPS) * F.col("tests") <= rate * F.col("claimed"))
    cuts = passed.groupBy("stratum").agg(F.min("level").alias("cut"))
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts"))  # one row of some hundred entries at most

    both = found.crossJoin(F.broadcast(cuts))
    own = F.filter("random", lambda c: (c["apart"] == 1) & (c["level"] > 0) & F.coalesce(c["level"] >= F.try_element_at("cuts", c["stratum"]), F.lit(False)))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), (s["kind"] + 1).cast("int")), s["start"], s["end"])), ",")
    plain = F.transform(own, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return both.select(
        "doc_id", *[many(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])],
        F.sha2(shown(F.array_sort("base")).cast("binary"), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", plain))).alias("spans"),
    )
