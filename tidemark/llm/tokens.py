"""Encoding of whole texts word by word, each distinct word once, and helpers for rows of ids.

A vocabulary that never joins characters across a single space gives a text the ids of its space-separated words, one
after the other. A word's ids come from the library and are remembered in the worker. Texts where a word touches other white space at its edge (runs of blanks, leading or trailing ones) are the cases in
which that need not hold; those are encoded whole by the library.
"""

from __future__ import annotations

import zlib
from itertools import chain, repeat

import numpy as np

#: Marks the first word of a text; a lone surrogate occurs in no text that came from UTF-8.
_FIRST = "\udc80"


class WordMemo:
    """Ids of texts. ``lead`` is what stands before every word but the first, ``lead_first`` before the first one."""

    def __init__(self, encode_batch, lead: str, lead_first: str, whole, drops_space: bool = False, max_words: int = 500_000):
        self.encode_batch, self.lead, self.lead_first, self.whole = encode_batch, lead, lead_first, whole
        self.drops_space, self.max_words = drops_space, max_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)

    def _add(self, words: list[str]) -> None:
        texts = [self.lead_first + w[1:] if w[:1] == _FIRST else self.lead + w for w in words]
        ids = self.encode_batch(texts)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        odd = np.fromiter((self._is_odd(w) for w in words), bool, len(words))
        self.odd = np.concatenate([self.odd, odd])
        self.used += len(flat)
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))

    def _is_odd(self, word: str) -> bool:
        if self.drops_space:
            return False
        bare = word[1:] if word[:1] == _FIRST else word
        return not bare or bare[0].isspace() or bare[-1].isspace() or bare[0] == "▁" or bare[-1] == "▁"

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins in them and, last, where the last one ends)."""
        if len(self.index) > self.max_words:
            self._clear()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        marks = self.lead_first != self.lead
        for k, text in enumerate(texts):
            parts = text.split(" ")
            if marks:
                parts[0] = _FIRST + parts[0]
            counts[k] = len(parts)
            words += parts
        codes = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing))
            self._add(new)
            codes[missing] = np.fromiter((self.index[words[i]] for i in missing), np.int64, len(missing))
        del words
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.start[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        word_end = np.cumsum(counts)
        bounds = np.concatenate([[0], ends[word_end - 1]]) if len(texts) else np.zeros(1, np.int64)
        odd = np.flatnonzero(np.add.reduceat(self.odd[codes], word_end - counts)) if len(texts) else []
        if len(odd):
            parts = [flat[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            for k, ids in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
                parts[k] = np.asarray(ids, np.uint32)
            flat = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, bounds.astype(np.int64)


def with_end(flat: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with the id ``end`` after each text."""
    n = len(bounds) - 1
    out = np.empty(len(flat) + n, np.uint32)
    ends = bounds[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = flat
    out[ends] = end
    return out, bounds + np.arange(n + 1)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def text_batches(texts: list[str | None], max_chars: int = 2_000_000):
    """(first row, texts) in slices of bounded size, a null as an empty text."""
    first, size, part = 0, 0, []
    for k, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= max_chars:
            yield first, part
            first, size, part = k + 1, 0, []
    if part:
        yield first, part
