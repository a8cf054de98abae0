"""Shared members of many sorted sets in one process: an inverted index, with a matrix product for what most sets hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_GATHER = 1 << 21  # index entries, or cells of the table of counts, looked at at once
_CELLS = 1 << 23  # cells of the 0/1 table of values that most sets hold
_FREQUENT = 64  # a value is counted by the product if so many sets, and an eighth of all, hold it


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), size)


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, members that left[a] and right[b] share) for all pairs that share any; without ``right``, pairs a < b of left.

    Sets have distinct members. The work is what the pairs share in all, not the number of pairs, unless most pairs do.
    """
    own, right = right is None, left if right is None else right
    if not left or not right:
        return
    flat, owner = _flat(right)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    values, count = flat[begin], np.diff(np.concatenate([begin, [len(flat)]]))
    members, row = _flat(left)
    if not len(values) or not len(members):
        return
    place = np.minimum(np.searchsorted(values, members), len(values) - 1)
    hit = (values[place] == members) & (count[place] > int(own))
    place, row = place[hit], row[hit]
    n = len(right)
    frequent = np.flatnonzero(count >= max(_FREQUENT, n // 8))
    frequent = frequent[np.argsort(-count[frequent], kind="stable")[: _CELLS // n]]
    column = np.full(len(values), -1)
    column[frequent] = np.arange(len(frequent))
    table = None
    if len(frequent):
        table = np.zeros((n, len(frequent)), np.float32)
        at = np.repeat(column, count)
        table[owner[at >= 0], at[at >= 0]] = 1
    rare = column[place] < 0
    cost = np.bincount(row[rare], count[place[rare]], len(left)) + (n if table is not None else 0)
    task = (np.cumsum(cost) // _GATHER).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(left)]])
    for r0, r1 in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = slice(*np.searchsorted(row, [r0, r1]))
        p, r, some = place[mine], row[mine] - r0, rare[mine]
        times = count[p[some]]
        at = np.repeat(begin[p[some]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        a, b = np.repeat(r[some], times), owner[at]
        if own:
            a, b = a[b > a + r0], b[b > a + r0]
        cells = (r1 - r0) * n
        if table is not None or cells <= 4 * len(a):
            shared = np.bincount(a * n + b, minlength=cells)
            if table is not None:
                held = np.zeros((r1 - r0, len(frequent)), np.float32)
                held[r[~some], column[p[~some]]] = 1
                shared += (held @ table.T).astype(np.int64).ravel()
            key = np.flatnonzero(shared)
            shared = shared[key]
        else:
            key, shared = np.unique(a * n + b, return_counts=True)
        a, b = key // n + r0, key % n
        if own:
            a, b, shared = a[b > a], b[b > a], shared[b > a]
        if len(a):
            yield a, b, shared


def forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that span the components of all links (a, b) between n nodes, the least node of each node's component).

    In each round every component with a link to one of a smaller label takes one such link and joins it, so that no
    circle can arise.
    """
    label, out = np.arange(n), []
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, one = np.unique(np.maximum(x, y), return_index=True)
            out += zip(a[one].tolist(), b[one].tolist(), strict=True)
            label_of = np.arange(n)
            label_of[high] = np.minimum(x, y)[one]
            while True:
                further = label_of[label_of]
                if np.array_equal(further, label_of):
                    break
                label_of = further
            label = label_of[label]
    return out, label
