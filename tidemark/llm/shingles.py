"""Words and word shingles of whole batches of texts as 64-bit numbers, computed on the bytes with NumPy.

A word is a run of bytes other than blank and 9 to 13, with A-Z lower-cased. Its number is a polynomial in random byte
values modulo 2**64, mixed; a shingle's number is made of its words' numbers. Equal words always have equal numbers;
different ones share a number with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


#: Letters: of ASCII, and all bytes of other characters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _fold_case() -> np.ndarray:
    low = np.arange(256)
    low[65:91] += 32
    return _BYTE[low]


_VALUE = _fold_case()
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, b in (("up", _BASE), ("down", inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


def blocks(texts: pa.Array, max_rows: int = 1000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each text begins and the last one ends) for runs of rows of about half a megabyte."""
    texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = min(first + max_rows, max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, "right")) - 1))
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = _IS_WORD, prefixes: tuple[int, ...] = ()) -> tuple:
    """(numbers of all words, first word of each text and their total, where words begin, where they end).

    ``kind`` says of each byte whether it belongs to words. For each of ``prefixes`` a further array has the numbers of
    the words' first so many bytes.
    """
    n = len(data)
    inside = kind[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    numbers = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    heads = [mix((total[np.minimum(end, start + k)] - total[start]) * down[start] + np.array([k << 20], np.uint64) * _STEP) for k in prefixes]
    return numbers, np.searchsorted(start, bounds), start, end, *heads


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of the texts in a row, number of them in each text), block by block.

    A text of fewer than ``k`` words, but at least one, has its whole sequence as its only shingle.
    """
    for first, data, bounds in blocks(texts):
        numbers, at, *_ = words(data, bounds)
        grams = numbers[: max(0, len(numbers) - k + 1)].copy()
        for j in range(1, k):
            grams = grams * _STEP + numbers[j : j + len(grams)]
        grams = mix(grams)
        sets, sizes = [], np.zeros(len(bounds) - 1, np.int64)
        for row in range(len(bounds) - 1):
            a, b = at[row], at[row + 1]
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            elif b > a:
                x = numbers[a : a + 1].copy()
                for j in range(a + 1, b):
                    x = x * _STEP + numbers[j]
                s = mix(x + np.array([b - a], np.uint64) * _BASE)
            else:
                continue
            sets.append(s)
            sizes[row] = len(s)
        yield first, np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes
