"""Encoding of whole texts with the tokenizers library, segment by segment and each distinct segment once.

Both vocabularies in use cut a text by a pattern before they merge characters, and merges never cross a cut. Here the
cuts are found on the bytes of many texts at once: a chunk of characters other than ASCII white space is cut where Latin
letters, digits and marks meet; a chunk with any other character stays whole. A byte-level segment carries the blank
before it, and further white space makes segments of its own, by the rules of the pattern. A segment's ids come from the
library and are remembered under a 64-bit hash in a table of fixed size. A text with a chunk that begins or ends in
white space beyond ASCII, where these rules could fail, is encoded whole by the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa

from tidemark.llm.shingles import blocks, mix, powers

_U = np.uint64
_WS, _LETTER, _DIGIT, _MARK, _LEAD, _TRAIL, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, *range(9, 14)]] = _WS
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK  # but for the apostrophe
_CLASS[0xC3] = _LEAD  # of U+00C0 to U+00FF: letters but for the signs of multiplication and division
_CLASS[0x80:0xC0] = _TRAIL
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)


def _runs(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end; a run never crosses a cut."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class _Table:
    """Numbers by 64-bit key, in open addressing over whole arrays; rows of ids by number."""

    def __init__(self, bits: int = 22):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, _U)
        self.numbers = np.zeros(1 << bits, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)
        self.used = 0

    def full(self) -> bool:
        return len(self.start) > 1 << (self.bits - 2)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.numbers[slot], -1).astype(np.int64)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.numbers[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, flat: np.ndarray, lengths: np.ndarray, odd: np.ndarray) -> None:
        """Rows for keys that are distinct and new."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        numbers = np.arange(len(self.start), len(self.start) + len(keys), dtype=np.int32)
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.odd = np.concatenate([self.odd, odd])
        self.used += len(flat)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.numbers[slot[won]] = numbers[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask


class SegmentEncoder:
    """Encodes columns of texts. ``byte_level``: white space belongs to the ids; else it is dropped and case ignored."""

    def __init__(self, path: str, byte_level: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer: Any = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.byte_level = byte_level
        self.table = _Table()

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _segments(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where segments begin, where they end, bytes with the case of letters folded if it is ignored)."""
        n = len(data)
        kind = _CLASS[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        low = data
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            after = np.minimum(lead + 1, n - 1)
            fine = (kind[after] == _TRAIL) & (data[after] != 0x97) & (data[after] != 0xB7) & (after > lead)
            kind[lead[fine]] = _LETTER
            kind[after[fine]] = _LETTER
        if not self.byte_level:
            low = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
            if len(lead):
                big = after[fine & (data[after] < 0x9F)]
                low[big] += 32
        kind[kind >= _LEAD] = _OTHER
        begin, end = _runs(kind != _WS, cut)
        other = np.zeros(n + 1, np.int32)
        np.cumsum(kind == _OTHER, out=other[1:])
        plain = other[end] == other[begin]
        change = np.zeros(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != _WS) & (kind[:-1] != _WS)
        change[begin] = False
        inner = np.flatnonzero(change)
        if len(inner):
            inner = inner[plain[np.searchsorted(begin, inner, "right") - 1]]
        first = begin.copy()
        pieces_a, pieces_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.byte_level:
            blank = (begin > 0) & ~cut[begin]
            blank[blank] = data[begin[blank] - 1] == 32
            first = begin - blank
            a, b = _runs(kind == _WS, cut)
            last = cut[b]
            more = np.where(last, b, b - 1)  # all but the last white space before a chunk
            single = ~last & (data[b - 1] != 32)
            held = more > a
            pieces_a = np.concatenate([a[held], b[single] - 1])
            pieces_b = np.concatenate([more[held], b[single]])
        mark = np.zeros(n + 1, np.int8)
        mark[inner] = 1
        starts = np.concatenate([first, inner, pieces_a])
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        stops = np.concatenate([np.full(len(first) + len(inner), -1, np.int64), pieces_b])[order]
        open_ = stops < 0
        where = np.searchsorted(begin, starts[open_] + 1, "right") - 1  # the chunk of each segment
        where = np.where((where + 1 < len(begin)) & (first[np.minimum(where + 1, len(begin) - 1)] == starts[open_]), where + 1, where)
        following = np.concatenate([starts[open_][1:], [n]])
        stops[open_] = np.minimum(end[where], following)
        return starts, stops, low

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each begins in them and, last, where the last one ends)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.table.full():
            self.table = _Table(self.table.bits)
        starts, stops, low = self._segments(data, bounds)
        n = len(data)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[low] * up[:n], out=sums[1:])
        keys = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(_U)) | _U(1)
        numbers = self.table.find(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            raw = low.tobytes()
            at = missing[one]
            texts = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            for k in range(0, len(texts), 8192):
                part = texts[k : k + 8192]
                ids = self.library(part)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
                odd = np.fromiter((not t.isascii() and (t.lstrip(" ")[:1].isspace() or t[-1:].isspace()) for t in part), bool, len(part))
                self.table.add(new[k : k + 8192], flat, lengths, odd)
            numbers[missing] = self.table.find(keys[missing])
        lengths = self.table.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.table.ids[np.repeat(self.table.start[numbers] - (ends - lengths), lengths) + np.arange(total)]
        segment = np.searchsorted(starts, bounds)
        at = np.concatenate([[0], ends])[segment]
        odd = self.table.odd[numbers]
        if odd.any():
            raw = data.tobytes()
            texts = np.unique(np.searchsorted(bounds, starts[odd], "right") - 1).tolist()
            parts = [flat[at[k] : at[k + 1]] for k in range(len(bounds) - 1)]
            for k, ids in zip(texts, self.library([raw[bounds[k] : bounds[k + 1]].decode() for k in texts]), strict=True):
                parts[k] = np.asarray(ids, np.uint32)
            flat = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, at.astype(np.int64)

    def columns(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) of a column of texts, in blocks; a null is an empty text."""
        for first, data, bounds in blocks(texts):
            flat, at = self.encode(data, bounds)
            yield first, flat, at


_LOADED: dict[tuple[str, bool], SegmentEncoder] = {}


def encoder(path: str, byte_level: bool) -> SegmentEncoder:
    """The encoder of a tokenizers file, kept for the life of the worker."""
    if (path, byte_level) not in _LOADED:
        _LOADED[path, byte_level] = SegmentEncoder(path, byte_level)
    return _LOADED[path, byte_level]
