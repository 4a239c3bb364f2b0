"""Words of whole texts as Arrow strings, found by byte masks over runs of texts.

A mask says which bytes belong to a word; it has to hold or leave out whole
UTF-8 characters. Words are compared as strings, never by hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sessionloom.llm.shingles import LOWER

#: Bytes of text that are cut into words at once; of a longer text, so many and the rest of a word.
PIECE = 8_000_000


def pieces(column: pa.Array, size: int = PIECE):
    """(rows from, to, bytes, starts) of a string column, in runs of about ``size`` bytes; nulls count as empty, a text is never cut."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        at = to


def spans(full: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of set bytes; a run ends where its text does."""
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = starts[(starts > 0) & (starts < len(full))]
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    if not len(begin):
        return pa.array([], pa.large_string())
    offsets = np.stack([begin, end], axis=1).reshape(-1).astype(np.int64)  # every other string is what stands between
    every = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return every.take(pa.array(np.arange(0, len(offsets) - 1, 2)))


def counted(data: np.ndarray, starts: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text number, word number, times) of the distinct words of each text, and the words; A-Z lower-cased."""
    begin, end = spans(mask(data), starts)
    coded = strings(LOWER[data], begin, end).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    width = max(1, len(words))
    key, times = np.unique((np.searchsorted(starts, begin, side="right") - 1) * width + codes, return_counts=True)
    return key // width, key % width, times, words


def word_counts(column: pa.Array, mask, size: int = PIECE):
    """(rows from, to, text number, word number, times, words) of runs of texts, as of ``counted``.

    A text longer than ``size`` bytes is cut between words, and its counts are put together.
    """
    for at, to, data, starts in pieces(column, size):
        if to - at > 1 or len(data) <= size:
            yield at, to, *counted(data, starts, mask)
            continue
        parts, low = [], 0
        while low < len(data):
            high = min(len(data), low + size)
            while high < len(data):  # on to the end of the word
                gap = np.flatnonzero(~mask(data[max(low, high - 1) : high + size])[1:])
                if len(gap):
                    high += int(gap[0])
                    break
                high = min(len(data), high + size)
            _, codes, times, words = counted(data[low:high], np.zeros(1, np.int64), mask)
            parts.append(pa.table({"word": words.take(pa.array(codes)), "times": times}))
            low = high
        whole = pa.concat_tables(parts).group_by("word").aggregate([("times", "sum")]).combine_chunks()
        times = whole.column("times_sum").to_numpy()
        yield at, to, np.zeros(len(times), np.int64), np.arange(len(times)), times, pc.cast(whole.column("word").combine_chunks(), pa.large_string())
