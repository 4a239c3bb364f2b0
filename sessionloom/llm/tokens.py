"""Exact subword ids for whole texts inside Spark tasks, through a piece cache.

A text is cut only at places that its tokenizer never joins characters across,
so its ids are the ids of its pieces in turn. Words repeat, so most pieces come
from a bounded cache and only new ones reach the tokenizer.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters with the Unicode property White_Space (fixed values).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: How byte-level tokenizers cut a text (a fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How the words' tokenizer cuts a text (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What stands between blanks.
WORD_PIECES = re.compile(rf"[^{BLANKS}]+")
#: Beyond ASCII and the Latin letters to U+017F, lower case, blanks and composed forms are left to the tokenizer.
BEYOND_LATIN = r"[^\x00-\x7f\x{a1}-\x{12f}\x{131}-\x{17f}]"
NOT_LATIN = re.compile("[^\0-\x7f\xa1-\u012f\u0131-\u017f]")
#: Leads the cache keys of pieces of such texts, which no piece can hold.
BEYOND = " "
#: Cached pieces per worker, beside those of the texts at hand.
CACHE_PIECES = 500_000


class _Numbers(dict):
    """Numbers pieces as they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class RankEncoder:
    """The byte-level vocabulary of a tokenizers file, merged by rank.

    Ids are those of the tokenizers library. Its file's merges are in order of
    rank, so the faster rank merger gives the same ids on Latin text; any text
    with other characters, whose classes may differ by Unicode version, and any
    text that holds the string of an added token goes to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = added_tokens(self.tokenizer)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if i not in special}
        self.merger = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; null counts as empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if NOT_LATIN.search(text) or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.merger.encode_ordinary(text), np.uint32)


class PieceEncoder:
    """Encodes whole texts by a tokenizer that lower-cases, drops blanks and joins nothing across them.

    Ids are those of the tokenizers library for the whole text. Pieces of
    Latin text that are new to the cache go to the tokenizer's own model, cut by
    the tokenizer's own pattern; other texts are cut at blanks alone, and their
    pieces go to the tokenizer as they are. A text that holds the string of an added token
    goes there whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = added_tokens(self.tokenizer)
        self.words = regex.compile(WORD_PATTERN)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def numbered(self, pieces: list[str], latin: bool) -> np.ndarray:
        """The pieces' numbers in the cache, which learns the new ones."""
        known = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces))
        new, parts = list(islice(self.numbers, known, None)), []
        if latin:
            # a piece of several words, or of words and marks, is put together from those
            cut = self.words.findall
            parts = [(k, own) for k, piece in enumerate(new, known) if not piece.isalpha() and len(own := cut(piece)) != 1]
            held = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(own for _, own in parts)), np.int32)
            new = list(islice(self.numbers, known, None))
        starts, lengths = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        several = {k - known for k, _ in parts}
        single = [k for k in range(len(new)) if k not in several and new[k]]
        ids, base = [self.ids], len(self.ids)
        for at in range(0, len(single), 4096):
            some = single[at : at + 4096]
            if latin:
                found = self.model.encode_batch_fast([[new[k] for k in some]], is_pretokenized=True, add_special_tokens=False)[0]
                ids.append(np.array(found.ids, np.uint32))
                own = np.diff(np.flatnonzero(self.closing[ids[-1]]), prepend=-1)
            else:
                each = [encoded(self.tokenizer, new[k]) for k in some]
                own = np.array([len(x) for x in each], np.int64)
                ids.append(np.array([i for x in each for i in x], np.uint32))
            starts[some], lengths[some] = base + np.cumsum(own) - own, own
            base += int(own.sum())
        self.ids = np.concatenate(ids)
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        if parts:
            found, sizes = self.ids_of(held, np.array([len(own) for _, own in parts]))
            at = np.array([k for k, _ in parts])
            self.starts[at], self.lengths[at] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
            self.ids = np.concatenate([self.ids, found])
        return numbers

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its ids as unsigned 32-bit integers; null counts as empty."""
        if len(self.numbers) > CACHE_PIECES:
            self.forget_rare()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pc.match_substring_regex(texts, BEYOND_LATIN)
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, token))
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(apart, "", texts)))
        pieces = cut.flatten().dictionary_encode()
        numbers = self.numbered(pieces.dictionary.to_numpy(zero_copy_only=False), True)
        ids, sizes = self.ids_of(numbers[pieces.indices.to_numpy()] if len(numbers) else numbers, np.diff(cut.offsets.to_numpy()))
        found = np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []
        for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            if any(x in text for x in self.added):
                found[i] = np.array(encoded(self.tokenizer, text), np.uint32)
            else:
                own = WORD_PIECES.findall(text)
                found[i] = self.ids_of(self.numbered([BEYOND + x for x in own], False), np.array([len(own)]))[0]
        return found

    def ids_of(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered pieces, and how many each run of ``sizes`` pieces has."""
        self.uses += np.bincount(numbers, minlength=len(self.uses)).astype(np.int32)
        n = self.lengths[numbers]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - n), n)
        return self.ids[places], np.diff(np.concatenate([[0], ends])[np.cumsum(sizes)], prepend=0)

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts, self.lengths, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def forget_rare(self) -> None:
        """Keep the pieces used most, half the cache at most."""
        least = max(2, int(np.partition(self.uses, -(CACHE_PIECES // 2))[-(CACHE_PIECES // 2)]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        names, starts, lengths = list(self.numbers), self.starts[kept], self.lengths[kept]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
        self.numbers = _Numbers((names[k], n) for n, k in enumerate(kept.tolist()))
        self.starts, self.lengths, self.uses = ends - lengths, lengths, self.uses[kept] // 2


def encoded(tokenizer, text: str) -> list[int]:
    return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def added_tokens(tokenizer) -> list[str]:
    return [x.content for x in tokenizer.get_added_tokens_decoder().values()]


def runs(texts: pa.Array, size: int = 2_000_000):
    """Parts of a column of about so many bytes, which bounds memory, and where they begin."""
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while at < len(sizes):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + size, side="right")))
        yield texts.slice(at, to - at), at
        at = to


@lru_cache(maxsize=4)
def rank_encoder(path: str) -> RankEncoder:
    """One per worker, kept from task to task."""
    return RankEncoder(path)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One per worker, kept from task to task."""
    return PieceEncoder(path)
