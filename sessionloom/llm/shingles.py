"""Hashed word-shingle sets and SuperMinHash signatures of whole texts, vectorised over batches.

A word's hash is a difference of prefix sums of its lower-cased bytes, so a
batch of texts is hashed in a few passes over one byte array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Multiplier of the byte polynomial, its inverse modulo 2**64, and odd mixing constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ODD = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: The number that a byte counts as in a word's hash.
VALUE = LOWER.astype(U) + U(1)
#: Bytes of text that are hashed at once; each takes several arrays of 8 bytes meanwhile.
CHUNK = 500_000

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * ODD[0]
    x = x ^ (x >> U(27))
    x = x * ODD[1]
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(-(-(n - 1) // CHUNK) * CHUNK + 1, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers


def words(data: np.ndarray, starts: np.ndarray, gap: np.ndarray = BLANK, opening: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word of texts that stand in ``data`` from ``starts`` on.

    Words are parted by the bytes in ``gap``. With ``opening``, words of more
    bytes than that are followed, at the end, by the hashes of their first so many bytes.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U)
    full = ~gap[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = full[inner]
    last = full.copy()
    last[:-1] &= ~full[1:]
    last[inner - 1] = full[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = powers(len(data) + 1)
    sums = VALUE[data]
    sums *= power[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(begin > 0, sums[begin - 1], U(0))
    hashes = mix((sums[end] - before) * inverse[begin] + (end - begin).astype(U) * ODD[2])
    owner = np.searchsorted(starts, begin, side="right") - 1
    if opening:
        longer = np.flatnonzero(end - begin >= opening)
        own = (sums[begin[longer] + opening - 1] - before[longer]) * inverse[begin[longer]]
        return np.concatenate([owner, owner[longer]]), np.concatenate([hashes, mix(own + ODD[4])])
    return owner, hashes


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of ``size`` words, sorted; with fewer words, all of them as one."""
    text, hashes = words(data, starts)
    n = len(starts)
    counts = np.bincount(text, minlength=n)
    begin = np.cumsum(counts) - counts
    rolled = np.zeros(max(0, len(hashes) - size + 1), U)
    for k in range(size):
        rolled += hashes[k : k + len(rolled)] * ODD[k % 5] * U(2 * (k // 5) + 1)
    rolled = mix(rolled)
    out = []
    for at, many in zip(begin.tolist(), counts.tolist(), strict=True):
        if many >= size:
            out.append(np.unique(rolled[at : at + many - size + 1]))
        elif many:
            whole = np.full(1, many, U) * ODD[3]
            for k in range(many):
                whole += hashes[at + k : at + k + 1] * ODD[k % 5]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, U))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` unsigned values for each set; empty sets give the largest value.

    Step j gives every element the value j plus a fraction at the j-th place of
    its own random permutation. All elements of a set go through step j at once;
    a set stops after the step in which its last place was filled, as no later
    value can be smaller.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), m), np.iinfo(U).max, U)
    flat = out.reshape(-1)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = None
    for j in range(m):
        if not len(element):
            break
        random = mix(element + U((j + 1) * BASE % (1 << 64)))
        k = j + ((random & U(0xFFFFFF)) % U(m - j)).astype(np.int64)
        if j == 0:
            chosen = k
        else:
            rows = np.arange(len(element))
            if place is None:
                place = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
                place[rows, 0], place[rows, first] = first, 0
            chosen = place[rows, k].astype(np.int64)
            place[rows, k] = place[rows, j]
        np.minimum.at(flat, owner * m + chosen, U(j) << U(56) | random >> U(8))
        open_ = (out == np.iinfo(U).max).any(axis=1)[owner]
        if j == 0:
            first = chosen[open_].astype(np.uint8)
        elif not open_.all():
            place = place[open_]
        element, owner = element[open_], owner[open_]
    return out


def text_chunks(column: pa.Array, size: int = CHUNK):
    """(rows from, to, bytes, starts) of a string column, in runs of about ``size`` bytes; nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        at = to


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of signed 64-bit integers."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def common_counts(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of two lists, whose items stand one set after the other."""
    both = np.intersect1d(a, b)
    out = np.zeros((len(sizes_a), len(sizes_b)), np.float32)
    sides = []
    for items, sizes in ((a, sizes_a), (b, sizes_b)):
        owner, at = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(both, items)
        kept = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == items) if len(both) else np.zeros(len(items), bool)
        sides.append((owner[kept], at[kept]))
    for low in range(0, len(both), width):
        held = []
        for (owner, at), sizes in zip(sides, (sizes_a, sizes_b), strict=True):
            inside = (at >= low) & (at < low + width)
            dense = np.zeros((len(sizes), min(width, len(both) - low)), np.float32)
            dense[owner[inside], at[inside] - low] = 1
            held.append(dense)
        out += held[0] @ held[1].T
    return np.rint(out).astype(np.int64)
