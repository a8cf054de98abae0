"""Operator 5, n-gram Jaccard join: all documents linked by the similarity of their shingle sets, exactly.

Method: pigeonhole over a partition of the universe of shingle hashes.

* Sets r and s have Jaccard similarity num/den or more exactly when |r - s| + |s - r| <= U = (|r| + |s|)(den - num)/(den + num).
* Sizes are cut into bands that grow threefold. Each band cuts the universe into m segments. A difference spoils at most
  one segment, so of the segments that hold something in either set at least max(k(r), k(s)) - U are alike, where k counts
  a set's non-empty segments. A set is indexed in its own band, and in the next one if a partner can be there.
* Cost-based allocation: a signature (segment and content) costs as much as it is frequent. By the prefix principle, sets
  indexed by their U + t cheapest signatures, in one order for all, share t of them if they are similar: ordered by the
  power of two of their known frequency, then by hash. Frequencies come from bounded summaries that every scan task makes
  of all its signatures. The order decides only the cost: the join is exact with any.
* A set with fewer than U + t non-empty segments is indexed with all of them, and again with one segment for each shingle.
* Sets so small that U is at most 1 have a single segment, indexed with its one-deletion neighbourhood.

Sets that share a signature form a group. Small groups are counted pair by pair, and only pairs that share t signatures
count; larger groups, and frequent signatures, which are dealt over tasks by a salt, tie all their sets to one of them.
The connected parts of this graph are then joined, each in a task by an inverted index: first over the smallest quarter
of the universe, where sets that differ by more than U are not similar, then what stays connected over whole sets,
exactly. Parts above a fixed number of shingles, or with a large share of all, are cut into blocks, and each pair of
blocks is a task. A task tells a spanning forest of the links it finds, and of each set the number of documents it links
to there. Every set of a part goes to as many tasks as the part has blocks; what is dealt at once is bounded by the
corpus, in rounds of tasks if need be. Summaries miss signatures of middling frequency, the more the larger the corpus,
and these tie unrelated sets to parts without end: if the large parts would be dealt oftener than the corpus is large,
the signatures of their sets are counted exactly and the sets indexed again, with the true order. Equal sets are one node throughout. Joins are by key with neither side broadcast, and what is joined is a table
and not an aggregation that keeps a key's rows in place, so that adaptive execution can split a hot key. Nothing but bounded tables and checksums comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, on_workers, partitions, settings, settle
from tidemark.llm.overlaps import forest, overlaps
from tidemark.llm.shingles import mix, shingle_sets

_U = np.uint64
_SALTS = 64
_SIG = 48  # bits of a signature
_HOT = 6  # signatures known to be in 2**_HOT sets or more are salted
_BATCH = 1 << 18
_SMALL = 16  # groups of so many sets are counted pair by pair
_LEAST, _MOST, _PER = 4, 32, 16  # bounds of t and shingles for each of its units


@dataclass(frozen=True)
class Similarity:
    """Threshold num/den, for words in shingles of ``k``."""

    num: int = 75
    den: int = 100
    k: int = 5

    def differences(self, sizes):
        """U for two sets whose sizes add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    @property
    def tiny(self) -> int:
        """The largest size at which U is at most 1 for two sets of it."""
        n = 0
        while self.differences(2 * (n + 1)) <= 1:
            n += 1
        return n

    @property
    def edges(self) -> np.ndarray:
        """First size of each band; the first band is that of tiny sets."""
        out = [1, self.tiny + 1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * 3)
        return np.array(out, np.int64)


def shared(n):
    """t: how many signatures a set of n shingles shares at least with every set that is similar and not smaller."""
    return np.clip(n // _PER, _LEAST, _MOST)


def identities(u: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, id) of each set: its size and 64 bits of a digest, which together are its identity. Empty sets have x = 0."""
    x, ids, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    raw = u.tobytes()
    for k, n in enumerate(sizes.tolist()):
        if n:
            ids[k] = int.from_bytes(hashlib.blake2b(raw[8 * at : 8 * (at + n)], digest_size=8).digest(), "little", signed=True)
            x[k] = n
            at += n
    return x, ids


def signatures(u: np.ndarray, sizes: np.ndarray, sim: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set of each signature, signature of 48 bits, how many of them each set needs) for every band and level."""
    edges = sim.edges
    own = np.searchsorted(edges, sizes, "right") - 1
    own[sizes == 0] = -9
    reach = (sim.num * edges + sim.den - 1) // sim.den  # the least size of a partner of a set in the band
    also = (own >= 0) & (sizes >= reach[np.clip(own + 1, 0, len(edges) - 1)])
    spread = mix(u)
    for band in np.unique(np.concatenate([own[own >= 0], own[also] + 1])).tolist():
        chosen = np.flatnonzero((own == band) | also & (own + 1 == band))
        take = np.zeros(len(sizes), bool)
        take[chosen] = True
        mine = np.repeat(take, sizes)
        v, s, n = u[mine], spread[mine], sizes[chosen]
        doc = np.repeat(np.arange(len(chosen)), n)
        tag = mix(np.array([band + 1], _U) * _U(0xA24BAED4963EE407))
        if band == 0:
            first = np.cumsum(n) - n
            whole = np.add.reduceat(s, first)
            sig = [mix(whole + n.astype(_U) * tag)]
            owner = [chosen]
            more = n[doc] > 1
            sig.append(mix(whole[doc] - s + (n[doc] - 1).astype(_U) * tag)[more])
            owner.append(chosen[doc[more]])
            need = np.zeros(len(sizes), np.int64)
            need[chosen] = n + 1
            yield np.concatenate(owner), np.concatenate(sig) >> _U(64 - _SIG), need
            continue
        top = int(edges[band + 1]) - 1
        largest = np.minimum(n * sim.den // sim.num, top)
        needed = sim.differences(n + largest) + shared(n)
        m = _U(max(2, round((top + 1) / 2)))
        segment = ((v >> _U(32)) * m) >> _U(32) if m < _U(1 << 31) else v
        place = doc.astype(_U) << _U(40) ^ segment
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(s)])
        stop = np.concatenate([start[1:], [len(v)]])
        sig = mix((sums[stop] - sums[start]) * _U(3) + (segment[start] + _U(1)) * tag)
        owner = doc[start]
        need = np.zeros(len(sizes), np.int64)
        need[chosen] = needed
        yield chosen[owner], sig >> _U(64 - _SIG), need
        poor = np.bincount(owner, minlength=len(chosen)) < needed
        if poor.any():
            single = poor[doc]
            need = np.zeros(len(sizes), np.int64)
            need[chosen[poor]] = needed[poor]
            yield chosen[doc[single]], mix(v[single] * _U(5) + tag) >> _U(64 - _SIG), need


@dataclass
class Costs:
    """Signatures with a known frequency, sorted, and the power of two of each, at most 15."""

    known: np.ndarray
    power: np.ndarray

    def of(self, sig: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(sig), _U)
        at = np.minimum(np.searchsorted(self.known, sig), len(self.known) - 1)
        return np.where(self.known[at] == sig, self.power[at], 0).astype(_U)


def cheapest(u: np.ndarray, sizes: np.ndarray, sim: Similarity, costs: Costs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, power of its frequency) of the signatures to index."""
    out = []
    for owner, sig, need in signatures(u, sizes, sim):
        key = np.sort(owner.astype(_U) << _U(52) | costs.of(sig) << _U(_SIG) | sig)
        have = np.bincount((key >> _U(52)).astype(np.int64), minlength=len(sizes))
        first = np.cumsum(have) - have
        quota = np.minimum(have, need)
        rank = np.arange(int(quota.sum())) - np.repeat(np.cumsum(quota) - quota, quota)
        key = key[np.repeat(first, quota) + rank]
        out.append(((key >> _U(52)).astype(np.int64), key & _U((1 << _SIG) - 1), (key >> _U(_SIG) & _U(15)).astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def _new(x: np.ndarray, ids: np.ndarray, seen: set) -> np.ndarray:
    """Which sets are not empty and come up for the first time in this task."""
    fresh = np.zeros(len(x), bool)
    for k, pair in enumerate(zip(x.tolist(), ids.tolist(), strict=True)):
        if pair[0] and pair not in seen:
            seen.add(pair)
            fresh[k] = True
    return fresh


def _only(u: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return u[np.repeat(keep, sizes)], sizes[keep]


class _Summary:
    """The most frequent of all signatures of a task, in bounded memory: counts of those met at least twice in a run."""

    def __init__(self, keep: int, run: int = 1 << 21):
        self.keep, self.run, self.parts, self.held = keep, run, [], 0
        self.sig, self.n = np.zeros(0, _U), np.zeros(0, np.int64)

    def add(self, sig: np.ndarray) -> None:
        self.parts.append(sig)
        self.held += len(sig)
        if self.held >= self.run:
            self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        sig, n = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.held = [], 0
        sig, n = np.concatenate([self.sig, sig[n > 1]]), np.concatenate([self.n, n[n > 1]])
        sig, where = np.unique(sig, return_inverse=True)
        n = np.bincount(where, n, len(sig)).astype(np.int64)
        if len(sig) > self.keep:
            top = np.sort(np.argpartition(n, -self.keep)[-self.keep :])
            sig, n = sig[top], n[top]
        self.sig, self.n = sig, n


_SCAN = "kind int, doc_id long, row long, x long, id long, n long"


def _scan_task(batches: Iterator[pa.RecordBatch], sim: Similarity, keep: int):
    """Rows of kind 0: a document's id, row, x, id and size; of kind 1: a signature (id) and how often (n) the task has it."""
    names, seen, summary = ["kind", "doc_id", "row", "x", "id", "n"], set(), _Summary(keep)
    for batch in batches:
        for first, u, sizes in shingle_sets(batch.column(1), sim.k):
            x, ids = identities(u, sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(x), pa.array(ids), pa.array(sizes)], names)
            for _, sig, _ in signatures(*_only(u, sizes, _new(x, ids, seen)), sim):
                summary.add(sig)
    summary.flush()
    m = len(summary.sig)
    if m:
        zero = pa.array(np.zeros(m, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), zero, zero, zero, pa.array(summary.sig.astype(np.int64)), pa.array(summary.n)], names)


def _fresh_sets(batches: Iterator[pa.RecordBatch], sim: Similarity, bits: np.ndarray | None):
    """(members, sizes, x, ids) of the sets that come up for the first time and whose bits are in the filter, if there is one."""
    seen: set = set()
    for batch in batches:
        for _, u, sizes in shingle_sets(batch.column(1), sim.k):
            x, ids = identities(u, sizes)
            found = x != 0 if bits is None else (x != 0) & in_filter(bits, x, ids)
            found &= _new(np.where(found, x, 0), ids, seen)
            if found.any():
                yield *_only(u, sizes, found), x[found], ids[found]


def _signature_task(batches: Iterator[pa.RecordBatch], sim: Similarity, bits: np.ndarray | None):
    """All signatures of the sets, of each the one column ``sig``."""
    for u, sizes, _, _ in _fresh_sets(batches, sim, bits):
        for _, sig, _ in signatures(u, sizes, sim):
            yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64))], ["sig"])


def _count_task(batches: Iterator[pa.RecordBatch], least: int):
    """(id, n) of the signatures that come ``least`` times or more, from signatures in order."""
    last, n = None, 0
    for batch in batches:
        sig, times = np.unique(batch.column(0).to_numpy(), return_counts=True)
        if not len(sig):
            continue
        if last is not None and last == sig[0]:
            times[0] += n
        elif last is not None and n >= least:
            sig, times = np.concatenate([[last], sig]), np.concatenate([[n], times])
        last, n = int(sig[-1]), int(times[-1])
        told = np.flatnonzero(times[:-1] >= least)
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(sig[told].astype(np.int64)), pa.array(times[told].astype(np.int64))], ["id", "n"])
    if n >= least:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([n], pa.int64())], ["id", "n"])


def _index_task(batches: Iterator[pa.RecordBatch], sim: Similarity, costs: Costs, bits: np.ndarray | None = None):
    """(key, x, id): a signature, with the set's salt if it is frequent, so that its sets spread over tasks."""
    for u, sizes, x, ids in _fresh_sets(batches, sim, bits):
        owner, sig, power = cheapest(u, sizes, sim, costs)
        key = sig.astype(np.int64) << 6 | np.where(power >= _HOT, ids[owner] & (_SALTS - 1), 0)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[owner]), pa.array(ids[owner])], ["key", "x", "id"])


_EDGES = "kind int, sig long, ax long, aid long, bx long, bid long, weight long"


def _edge_rows(kind: int, sig, ax, aid, bx, bid, weight) -> pa.RecordBatch:
    columns = [np.full(len(ax), kind, np.int32), *(np.asarray(c, np.int64) for c in (sig, ax, aid, bx, bid, weight))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "sig", "ax", "aid", "bx", "bid", "weight"])


def _groups_to_edges(key: np.ndarray, x: np.ndarray, ids: np.ndarray, sim: Similarity, costs: Costs, known: set[int]):
    """Edges of whole groups, from rows in order of (key, x, id)."""
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (x[1:] == x[:-1]) & (ids[1:] == ids[:-1])
    key, x, ids = key[~same], x[~same], ids[~same]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    hot = costs.of(key[start].astype(_U) >> _U(6)) >= _HOT
    if hot.any():
        at = start[hot]
        yield _edge_rows(2, key[at] >> 6, x[at], ids[at], x[at], ids[at], np.zeros(len(at)))
    held = size > 1
    if not held.any():
        return
    member = np.repeat(held, size)
    x, ids, size, hot = x[member], ids[member], size[held], hot[held]
    start = np.cumsum(size) - size
    group = np.add.reduceat(mix(ids.astype(_U) + mix(x.astype(_U))), start) ^ hot.astype(_U)
    _, once, times = np.unique(group, return_index=True, return_counts=True)
    tiny = x[start[once] + size[once] - 1] <= sim.tiny
    weight = np.where(tiny, _MOST, times)
    for n in range(2, _SMALL + 1):
        mine = (size[once] == n) & ~hot[once]
        if mine.any():
            a, b = np.triu_indices(n, 1)
            i, j = (start[once[mine]][:, None] + k for k in (a, b))
            i, j, w = i.ravel(), j.ravel(), np.repeat(weight[mine], len(a))
            near = x[j] * sim.num <= x[i] * sim.den
            i, j, w = i[near], j[near], w[near]
            if len(i):
                yield _edge_rows(0, np.zeros(len(i)), x[i], ids[i], x[j], ids[j], w)
    large = once[((size[once] > _SMALL) | hot[once])]
    large = large[[int(g) not in known for g in group[large].tolist()]] if len(large) else large
    if len(large):
        if len(known) < 1_000_000:
            known.update(group[large].tolist())
        first = np.repeat(start[large], size[large] - 1)
        rank = np.arange(len(first)) - np.repeat(np.cumsum(size[large] - 1) - (size[large] - 1), size[large] - 1)
        j = first + 1 + rank
        yield _edge_rows(1, np.zeros(len(j)), x[first], ids[first], x[j], ids[j], np.full(len(j), _MOST))


def _group_task(batches: Iterator[pa.RecordBatch], sim: Similarity, costs: Costs):
    """From rows in order of (key, x, id), the sets that share a key.

    Rows of kind 0: two sets of a small group and how many signatures have just that group; of kind 1: a set of a large
    group, or of a salted signature, and the group's first; of kind 2: a salted signature and the first set of its salt.
    A group that outgrows ``_BATCH`` rows is tied to its first set piece by piece, so that none is ever held whole.
    """
    known: set[int] = set()
    held: list[tuple] = []
    rows, open_ = 0, None  # (key, x, id) of the first set of a group that goes on

    def tied(key, x, ids):
        """The rows of the open group that begin the arrays, as a star; returns how many they are."""
        n = int(np.searchsorted(key, open_[0], "right"))
        whole = np.full(n, open_[1]), np.full(n, open_[2])
        return n, _edge_rows(1, np.zeros(n), *whole, x[:n], ids[:n], np.full(n, _MOST))

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        rows += batch.num_rows
        if rows < _BATCH:
            continue
        key, x, ids = (np.concatenate(c) for c in zip(*held, strict=True))
        if open_ is not None:
            n, edges = tied(key, x, ids)
            yield edges
            key, x, ids = key[n:], x[n:], ids[n:]
        if len(key):
            end = int(np.searchsorted(key, key[-1]))  # the last group may go on
            open_ = None
            if not end and len(key) >= _BATCH:
                open_, end = (key[0], x[0], ids[0]), len(key)
                if costs.of(key[:1].astype(_U) >> _U(6))[0] >= _HOT:
                    yield _edge_rows(2, key[:1] >> 6, x[:1], ids[:1], x[:1], ids[:1], np.zeros(1))
                yield tied(key, x, ids)[1]
            elif end:
                yield from _groups_to_edges(key[:end], x[:end], ids[:end], sim, costs, known)
            key, x, ids = key[end:], x[end:], ids[end:]
        held, rows = [(key, x, ids)], len(key)
    if held:
        key, x, ids = (np.concatenate(c) for c in zip(*held, strict=True))
        if open_ is not None and len(key):
            n, edges = tied(key, x, ids)
            yield edges
            key, x, ids = key[n:], x[n:], ids[n:]
        if len(key):
            yield from _groups_to_edges(key, x, ids, sim, costs, known)


def quarter(members: np.ndarray) -> np.ndarray:
    """32 bits of the members in the smallest quarter of the universe: no two sets differ there by more than in all."""
    return np.unique((members[members < _U(1 << 62)] >> _U(30)).astype(np.uint32))


def _sets_task(batches: Iterator[pa.RecordBatch], sim: Similarity, bits: np.ndarray | None, whole: bool):
    """(x, id, set or its quarter) of the sets whose bits are all set in the filter, if there is one."""
    for some, n, x, ids in _fresh_sets(batches, sim, bits):
        ends = np.cumsum(n)
        sets = [(some[b - k : b] if whole else quarter(some[b - k : b])).tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(ids), pa.array(sets, pa.binary())], ["x", "id", "members"])


def _places(x, ids, bits: int) -> list:
    h = mix(ids.astype(_U) * _U(0x9FB21C651E98DF25) + mix(x.astype(_U)))
    return [(h >> _U(s)) & _U(bits - 1) for s in (0, 17, 34)]


def in_filter(filter_: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``filter_``: words of 64 bits, a power of two of them."""
    out = np.ones(len(x), bool)
    for p in _places(x, ids, len(filter_) * 64):
        out &= (filter_[(p >> _U(6)).astype(np.int64)] >> (p & _U(63)) & _U(1)).astype(bool)
    return out


def _filter_task(batches: Iterator[pa.RecordBatch], bits: int):
    """The words of the filter that a task sets, each once: place and value."""
    own = np.zeros(bits // 64, _U)
    for batch in batches:
        x, ids = (c.to_numpy() for c in batch.columns)
        for p in _places(x, ids, bits):
            np.bitwise_or.at(own, (p >> _U(6)).astype(np.int64), _U(1) << (p & _U(63)))
    at = np.flatnonzero(own)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(own[at].view(np.int64))], ["at", "value"])


def linked(left: list, right: list | None, sim: Similarity, left_sizes: np.ndarray, right_sizes: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of similar sets; without ``right``, pairs of left. Of quarters: links that span what may be similar.

    Quarters of two sets whose members differ by no more than the whole sets may are likely, even if they share nothing:
    that is so if their slacks add up to zero or less. Whoever has such a partner has one in the set of the least slack.
    """
    other, other_sizes = (left, left_sizes) if right is None else (right, right_sizes)
    na, nb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (left, other))
    for a, b, both in overlaps(left, right):
        if whole:
            near = sim.den * both >= sim.num * (na[a] + nb[b] - both)
        else:
            near = na[a] + nb[b] - 2 * both <= sim.differences(left_sizes[a] + other_sizes[b])
        if near.any():
            yield a[near], b[near]
    if not whole:
        total, part = sim.den + sim.num, sim.den - sim.num
        slack_a, slack_b = total * na - part * left_sizes, total * nb - part * other_sizes
        i, j = int(np.argmin(slack_a)), int(np.argmin(slack_b))
        b = np.flatnonzero(slack_b + slack_a[i] <= 0)
        yield np.full(len(b), i), b
        a = np.flatnonzero(slack_a + slack_b[j] <= 0)
        yield a, np.full(len(a), j)


_LINKS = "kind int, ax long, aid long, bx long, bid long, n long"


def _join_task(batches: Iterator[pa.RecordBatch], sim: Similarity, whole: bool):
    """From rows in order of (part, i, j): the links within block i (if i = j) or between blocks i and j.

    Rows of kind 0: links that span the components of all; of kind 1 (whole sets only): a set and the documents it links to.
    """
    now: tuple | None = None
    held: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}

    def rows(kind: int, columns) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], ["kind", "ax", "aid", "bx", "bid", "n"])

    def done():
        nodes, two = list(held), bool(now) and now[2] != now[3]
        first = [k for k, n in enumerate(nodes) if not two or held[n][0] == now[2]]
        second = [k for k, n in enumerate(nodes) if held[n][0] == now[3]] if two else first
        sizes, docs = np.array([x for x, _ in nodes], np.int64), np.array([held[n][1] for n in nodes], np.int64)
        sets = [held[n][2] for n in nodes]
        held.clear()
        if not first or not second or len(nodes) < 2:
            return
        a_of, b_of, counts = np.array(first), np.array(second), np.zeros(len(nodes), np.int64)

        def links():
            for a, b in linked([sets[k] for k in first], [sets[k] for k in second] if two else None, sim, sizes[a_of], sizes[b_of], whole):
                a, b = a_of[a], b_of[b]
                if whole:
                    np.add.at(counts, a, docs[b])
                    np.add.at(counts, b, docs[a])
                yield a, b

        found, _ = forest(len(nodes), links())
        if found:
            yield rows(0, zip(*((*nodes[a], *nodes[b], 0) for a, b in found), strict=True))
        some = np.flatnonzero(counts).tolist()
        if some:
            yield rows(1, zip(*((*nodes[k], *nodes[k], int(counts[k])) for k in some), strict=True))

    for batch in batches:
        px, pid, i, j, own, x, ids, docs = (c.to_pylist() for c in batch.columns[:8])
        sets = batch.column(8)
        for k in range(batch.num_rows):
            key = (px[k], pid[k], i[k], j[k])
            if key != now:
                yield from done()
                now = key
            held[x[k], ids[k]] = own[k], docs[k], np.frombuffer(sets[k].as_buffer(), _U if whole else np.uint32)
    yield from done()


def _filter_of(needed: DataFrame, n: int, most_bits: int):
    """A filter of the ``n`` needed nodes, sent to all: 16 bits a node, or a little more; none where that is over ``most_bits``."""
    bits = 1 << 12
    while bits < 16 * n:
        bits *= 2
    if bits > most_bits:
        return None
    words = np.zeros(bits // 64, _U)
    marks = needed.select("x", "id").mapInArrow(lambda it: _filter_task(it, bits), "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value")).toArrow()  # at most bits / 64 rows
    words[marks.column(0).to_numpy()] = marks.column(1).to_numpy().view(_U)
    return needed.sparkSession.sparkContext.broadcast(words)


def _sets_of(chosen: DataFrame, needed: DataFrame, n: int, sim: Similarity, most_bits: int, whole: bool) -> DataFrame:
    """(x, id, members, ...) of the ``n`` needed nodes, by one scan and an exact join.

    A filter keeps other sets out of the shuffle; where there is none, the join alone finds the nodes.
    """
    sent = _filter_of(needed, n, most_bits)
    sets = chosen.mapInArrow(lambda it: _sets_task(it, sim, None if sent is None else sent.value, whole), "x long, id long, members binary")
    return sets.join(needed.hint("merge"), ["x", "id"])


#: A part of this many shingles may be cut into up to ``_SPREAD`` blocks for the sake of balance alone.
_WORTH, _SPREAD = 1 << 14, 32
#: Bytes of sets dealt at once: so many for each shingle of the corpus, or the latter number if that is more.
_AT_ONCE, _FEW_BYTES = 4, 1 << 28


def joined_parts(chosen: DataFrame, parts: DataFrame, docs_of: DataFrame, sim: Similarity, block: int, most_bits: int, whole: bool, corpus: int = 0) -> DataFrame:
    """The rows of ``_join_task`` for each part of the graph (node, label), by whole sets or by quarters.

    ``docs_of``: (x, id, docs), how many documents a node stands for. A part is cut into blocks of about ``block``
    shingles, and into more if it holds so large a share of all shingles that a task for each pair of blocks evens out.
    If more would be dealt than a corpus of ``corpus`` shingles allows at once, the sets are settled and dealt in rounds,
    each to a share of the tasks.
    """
    spark, width = chosen.sparkSession, partitions(chosen.sparkSession)
    size = parts.groupBy("label").agg(F.sum("node.x").alias("size"))
    total = parts.agg(F.sum("node.x"), F.count(F.lit(1))).first()
    even = F.when(F.col("size") >= _WORTH, F.least(F.lit(_SPREAD), F.ceil(F.sqrt(2.0 * width * F.col("size") / (total[0] or 1))))).otherwise(1)
    blocks = size.select("label", F.greatest(F.ceil(F.col("size") / block), even).cast("int").alias("blocks")).where("blocks > 1")
    blocks = settle(blocks, "jaccard-blocks")
    placed = parts.join(blocks.hint("merge"), "label", "left").select("node.x", "node.id", "label", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    if whole:
        placed = placed.join(docs_of.hint("merge"), ["x", "id"])
    else:
        placed = placed.withColumn("docs", F.lit(1).cast("long"))
    placed = settle(placed, "jaccard-parts")
    volume = (placed.agg(F.sum(F.col("x") * F.col("blocks"))).first()[0] or 0) * (8 if whole else 1)
    rounds = max(1, -(-volume // max(_AT_ONCE * corpus, _FEW_BYTES)))
    own = F.pmod(F.xxhash64("x", "id"), F.col("blocks")).cast("int")
    sets = _sets_of(chosen, placed, total[1], sim, most_bits, whole).withColumn("own", own)
    if rounds > 1:
        sets = settle(sets, "jaccard-sets")
    tasks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("label", "own", tasks.alias("other"), "x", "id", "docs", "members").select(F.col("label.x").alias("px"), F.col("label.id").alias("pid"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "id", "docs", "members")
    pair = F.col("j") * (F.col("j") + 1) / 2 + F.col("i")  # numbered from 0, so that the tasks of a part go to different partitions
    task = F.pmod(F.xxhash64("px", "pid") % width + pair.cast("long"), F.lit(width)).cast("int")
    told = []
    for k in range(rounds):
        now = dealt if rounds == 1 else dealt.where(F.pmod(F.xxhash64("px", "pid", "i", "j"), F.lit(rounds)) == k)
        now = now.repartitionById(width, task).sortWithinPartitions("px", "pid", "i", "j")
        told.append(settle(now.mapInArrow(lambda it: _join_task(it, sim, whole), _LINKS), "jaccard-links" if whole else "jaccard-likely"))
    discard(placed, blocks)
    if rounds == 1:
        return told[0]
    found = told[0]
    for more in told[1:]:
        found = found.unionByName(more)
    found = settle(found, "jaccard-links" if whole else "jaccard-likely")
    discard(sets, *told)
    return found


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 0").select(_node("ax", "aid").alias("a"), _node("bx", "bid").alias("b"))


def _stars(ax, aid, bx, bid) -> tuple:
    """Of edges between nodes (x, id): each node but the least of its component, with that one."""
    x, ids = np.concatenate([ax, bx]), np.concatenate([aid, bid])
    order = np.lexsort((ids, x))
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[order][1:] != x[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(fresh) - 1
    x, ids = x[order[fresh]], ids[order[fresh]]
    _, label = forest(len(x), [(number[: len(ax)], number[len(ax) :])])
    some = np.flatnonzero(label != np.arange(len(x)))
    return x[some], ids[some], x[label[some]], ids[label[some]]


def _contract_task(batches: Iterator[pa.RecordBatch]):
    """Edges with the same components as those of the task, of which it holds no more than about ``_BATCH``."""
    held: list[tuple] = []
    rows = 0

    def told(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["ax", "aid", "bx", "bid"])

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        rows += batch.num_rows
        if rows >= _BATCH:
            stars = _stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, rows = [stars], len(stars[0])
            if rows > _BATCH // 2:
                yield told(stars)
                held, rows = [], 0
    if rows:
        yield told(_stars(*(np.concatenate(c) for c in zip(*held, strict=True))))


def _contracted(edges: DataFrame, tag: str) -> DataFrame:
    ends = edges.select("a.x", "a.id", F.col("b.x").alias("bx"), F.col("b.id").alias("bid"))
    found = ends.mapInArrow(_contract_task, "ax long, aid long, bx long, bid long")
    return settle(found.select(_node("ax", "aid").alias("a"), _node("bx", "bid").alias("b")), tag)


def components(edges: DataFrame, tag: str, max_rounds: int = 60, few: int = _BATCH) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b): label is the least node of the component.

    Each task first replaces its edges by stars with the same components. If at most ``few`` are left, one task ends the
    work; else alternating large-star and small-star steps do (Kiveris et al., "Connected components in MapReduce and
    beyond"), each settled in the shared folder and deleted when the next one is; nothing but a count and a checksum
    comes to the driver. The many small plans are not compiled. The rounds needed grow as the logarithm of the longest
    path; if they do not suffice, that is an error.
    """
    with settings(edges.sparkSession, spark__sql__codegen__wholeStage="false"):
        now = _contracted(edges.where("a <> b"), tag)
        if now.count() <= few:
            then = _contracted(now.coalesce(1), tag)
            discard(now)
            now = then
        else:
            now = _star_rounds(now, tag, max_rounds)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _star_rounds(now: DataFrame, tag: str, max_rounds: int) -> DataFrame:
    last = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), tag)
        star = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        star = settle(star, tag)
        lower = settle(star.groupBy("a").agg(F.min("b").alias("m")), tag)
        hung = star.join(lower.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = hung.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        then = settle(down.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), tag)
        discard(now, least, star, lower)
        now = then
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == last:
            return now
        last = sign
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def _node(x: str, i: str):
    return F.struct(F.col(x).alias("x"), F.col(i).alias("id"))


@dataclass
class Join:
    """``documents``: doc_id, row, x, id, n_shingles. ``links``: a, b, verified; they span every component.

    ``counts``: x, id, links; the documents of other sets that a set is similar to. ``classes``: node, label.
    """

    documents: DataFrame
    links: DataFrame
    counts: DataFrame
    classes: DataFrame


def _costs(counted: DataFrame, most: int) -> Costs:
    """The most frequent of the counted signatures (id, n), at most ``most`` of them."""
    counted = settle(counted, "jaccard-frequent")
    by = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()  # at most 63 rows
    least, held = 99, 0
    for row in sorted(by, key=lambda r: -r["p"]):
        if held + row["count"] > most:
            break
        least, held = row["p"], held + row["count"]
    table = counted.where(F.floor(F.log2("n")) >= least).select("id", F.least(F.floor(F.log2("n")), F.lit(15)).cast("int").alias("p")).toArrow()  # at most ``most`` rows
    known, power = table.column(0).to_numpy().astype(_U), table.column(1).to_numpy()
    order = np.argsort(known)
    discard(counted)
    return Costs(known[order], power[order].astype(np.uint8))


def _candidates(chosen: DataFrame, sim: Similarity, costs: Costs, sent=None) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes that may be similar, the settled table they are read from); ``sent``: a filter of the sets, if any."""
    spark = chosen.sparkSession
    costs = spark.sparkContext.broadcast(costs)
    index = chosen.mapInArrow(lambda it: _index_task(it, sim, costs.value, None if sent is None else sent.value), "key long, x long, id long")
    dealt = index.repartition(partitions(spark), "key").sortWithinPartitions("key", "x", "id")
    found = settle(dealt.mapInArrow(lambda it: _group_task(it, sim, costs.value), _EDGES), "jaccard-groups")

    ends = ["ax", "aid", "bx", "bid"]
    enough = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.floor(F.col("ax") / _PER)))  # a is the smaller set
    pairs = found.where("kind = 0").groupBy(*ends).agg(F.sum("weight").alias("weight")).where(F.col("weight") >= enough).select(*ends)
    stars = found.where("kind = 1").select(*ends)
    salted = found.where("kind = 2").select("sig", _node("ax", "aid").alias("b"))
    first = salted.groupBy("sig").agg(F.min("b").alias("a"))
    across = salted.join(first.hint("merge"), "sig").select("a", "b")
    return pairs.unionByName(stars).select(_node("ax", "aid").alias("a"), _node("bx", "bid").alias("b")).unionByName(across), found


#: A part of so many blocks is a large one; exact counts send so many times the signatures that summaries do.
_LARGE, _MORE = 4, 8


def _refined(chosen: DataFrame, parts: DataFrame, sim: Similarity, corpus: int, block: int, most_bits: int, known: int) -> DataFrame:
    """The parts (node, label) with large ones divided anew, if dealing them by blocks takes more than the corpus.

    All signatures of the sets in large parts are counted, and the sets indexed again in the order of these counts, so
    that signatures of more than ``_SMALL`` sets come last. Similar sets are in one part before, and so they are after.
    """
    spark = chosen.sparkSession
    blocks = F.ceil(F.col("size") / block)
    large = settle(parts.groupBy("label").agg(F.sum("node.x").alias("size")).where(blocks >= _LARGE), "jaccard-large")
    if (large.agg(F.sum(F.col("size") * blocks)).first()[0] or 0) <= corpus:
        discard(large)
        return parts
    needed = settle(parts.join(large.hint("merge"), "label").select("node.x", "node.id"), "jaccard-needed")
    sent = _filter_of(needed, needed.count(), most_bits)
    sig = chosen.mapInArrow(lambda it: _signature_task(it, sim, None if sent is None else sent.value), "sig long")
    sig = sig.repartition(partitions(spark), "sig").sortWithinPartitions("sig")
    costs = _costs(sig.mapInArrow(lambda it: _count_task(it, _SMALL + 1), "id long, n long"), known * _MORE)
    edges, found = _candidates(chosen, sim, costs, sent)
    rest = parts.join(large.select("label").hint("merge"), "label", "left_anti").select(F.col("node").alias("a"), F.col("label").alias("b"))
    out = settle(components(edges.unionByName(rest), "jaccard-candidates"), "jaccard-candidates")
    discard(found, needed, large, parts)
    return out


def jaccard_join(
    docs: DataFrame, *, similarity: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, summary: int = 1 << 16, known: int = 1 << 18, filter_bits: int = 1 << 26, block: int = 1 << 19
) -> Join:
    """Finds links between documents whose shingle sets are similar; see the module for the method.

    A null text is empty; an empty text, or one without words, is linked with nothing. A text with fewer words than a
    shingle is one shingle. Rows with equal sets, repeated rows included, are one node. An empty table gives empty
    results. ``row_col`` (long) is passed on as ``row``; other columns are ignored. ``summary`` (signatures a task
    reports) and ``known`` (signatures sent to tasks) bound what is known of frequencies and change the cost alone; so do
    ``filter_bits``, the largest filter sent to the scan, and ``block``, the shingles that a task holds at most twice.
    """
    spark, sim = docs.sparkSession, similarity or Similarity()
    on_workers(spark)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("long").alias("row") if row_col is None else F.col(f"`{row_col}`").alias("row"))
    scan = settle(chosen.mapInArrow(lambda it: _scan_task(it, sim, summary), _SCAN), "jaccard-scan")
    documents = scan.where("kind = 0").select("doc_id", "row", "x", "id", F.col("n").alias("n_shingles"))
    corpus = documents.agg(F.sum("n_shingles")).first()[0] or 0
    edges, found = _candidates(chosen, sim, _costs(scan.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")), known))
    nodes = documents.where("n_shingles > 0").groupBy("x", "id").agg(F.count(F.lit(1)).alias("docs"))
    parts = settle(components(edges, "jaccard-candidates"), "jaccard-candidates")
    discard(found)
    parts = _refined(chosen, parts, sim, corpus, block * 4, filter_bits, known)
    likely = joined_parts(chosen, parts, nodes, sim, block * 4, filter_bits, whole=False, corpus=corpus)
    discard(parts)
    parts = settle(components(_edges(likely), "jaccard-likely"), "jaccard-likely")
    discard(likely)
    told = joined_parts(chosen, parts, nodes, sim, block, filter_bits, whole=True, corpus=corpus)
    discard(parts)
    counts = told.where("kind = 1").groupBy(F.col("ax").alias("x"), F.col("aid").alias("id")).agg(F.sum("n").alias("links"))
    classes = settle(components(_edges(told), "jaccard-components"), "jaccard-classes")
    return Join(documents, _edges(told), counts, classes)


def near_duplicate_classes(docs: DataFrame, *, similarity: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the least doc_id reachable by links, its own included), n_links.

    ``n_links`` counts the other rows that a row is linked to, those with an equal set included. A document without
    words is its own component and has no links. A null id counts as the greatest; a component of null ids alone has a
    null component_id. See ``jaccard_join`` for other cases.
    """
    joined = jaccard_join(docs, similarity=similarity, id_col=id_col, text_col=text_col, **options)
    documents = joined.documents.where("n_shingles > 0")
    nodes = documents.groupBy("x", "id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs")).withColumn("node", _node("x", "id"))
    labelled = nodes.join(joined.classes.hint("merge"), "node", "left").select("x", "id", "least", "docs", F.coalesce("label", "node").alias("label"))
    lowest = settle(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "jaccard-lowest")
    named = labelled.join(lowest.hint("merge"), "label").join(joined.counts.hint("merge"), ["x", "id"], "left")
    named = settle(named.select("x", "id", "component_id", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-named")
    found = documents.join(named.hint("merge"), ["x", "id"]).select("doc_id", "n_shingles", "component_id", "n_links")
    return found.unionByName(joined.documents.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns: of each component one, of those with the least id; a null id counts as the greatest.

    Rows are told apart by a number settled with them before the scan, never by their ids, which may be null or repeated.
    Documents without words all stay.
    """
    name = free_name(docs.columns, "_row")
    rows = settle(docs.withColumn(name, F.monotonically_increasing_id()), "jaccard-rows", compression="zstd")  # the largest table, beside the index
    joined = jaccard_join(rows, id_col=id_col, text_col=text_col, row_col=name, **options)
    documents = joined.documents.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    nodes = documents.groupBy("x", "id").agg(first.alias("first")).withColumn("node", _node("x", "id"))
    labelled = nodes.join(joined.classes.hint("merge"), "node", "left").select("x", "id", "first", F.coalesce("label", "node").alias("label"))
    kept = settle(labelled.groupBy("label").agg(F.min("first").alias("kept")), "jaccard-kept")
    named = settle(labelled.join(kept.hint("merge"), "label").select("x", "id", F.col("kept.row").alias("kept")), "jaccard-kept")
    gone = settle(documents.join(named.hint("merge"), ["x", "id"]).where("row <> kept").select(F.col("row").alias(name)), "jaccard-gone")
    return rows.join(gone.hint("merge"), name, "left_anti").drop(name)
