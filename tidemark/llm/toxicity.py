"""Operator 7, toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Weights. Words and their beginnings are counted by labelled documents that hold them. A word's share of toxic documents
is drawn towards that of its longest known beginning, and so on up to the share of all (nested Dirichlet priors); the
weight is the difference of log-odds to the share of all, for a share that is lower by 1.5 posterior standard deviations:
a word seen a few times proves little.

Scan. Each text is one pass over its words: a running sum of weight less drift that starts anew at zero. Its largest
value is the maximum-scoring segment; texts where that is significant are cut into all maximal segments (Ruzzo and
Tompa, linear time).

Calibration. Scores of random segments have an extreme-value law: in n words K n exp(-lambda S) segments of score S or
more are expected by chance (Karlin and Altschul). lambda and K come from clean labelled documents that the weights were
not counted on; the evidence of a text, summed over its significant segments, becomes a probability by a logistic curve
fitted to those same documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import on_workers, settle
from tidemark.llm.shingles import IS_LETTER, blocks, words

_U = np.uint64
PREFIXES = (3, 4, 5, 6, 8)  # bytes


@dataclass
class Model:
    keys: np.ndarray  # sorted numbers of words and beginnings
    toxic: np.ndarray
    total: np.ndarray
    share: float
    strength: float = 4.0
    doubt: float = 1.5
    drift: float = 1.0
    cap: float = 8.0
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = 0.0
    level: float = 0.01

    def weights(self, numbers: np.ndarray, heads: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Weight less drift of each word."""
        if not len(self.keys):
            return np.full(len(numbers), -self.drift)
        _, first, back = np.unique(numbers, return_index=True, return_inverse=True)
        p, seen = np.full(len(first), self.share), np.zeros(len(first))
        for k, level in zip((*PREFIXES, 0), (*heads, numbers), strict=True):
            key = level[first]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (lengths[first] > k)
            p = np.where(known, (self.toxic[at] + self.strength * p) / (self.total[at] + self.strength), p)
            seen = np.where(known, self.total[at], seen)
        p = np.maximum(p - self.doubt * np.sqrt(p * (1 - p) / (seen + self.strength + 1)), self.share / 8)
        w = np.log(p / (1 - p)) - math.log(self.share / (1 - self.share))
        return (np.clip(w, -self.cap, self.cap) - self.drift)[back]

    def surprise(self, score, n):
        """Minus the logarithm of how many segments of the score or more a clean text of n words would have (of 0: one at least)."""
        return self.lam * np.asarray(score) - np.log(np.maximum(self.k * np.asarray(n), 1))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(evidence) + self.offset, -50, 50)))


def squeezed(evidence):
    """Evidence on a scale where many passages say little more than a few."""
    return np.log1p(np.maximum(evidence, 0)) + np.minimum(evidence, 0) / 20


def best_segments(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The score of the maximum-scoring segment of each text, 0 if there is none; text k has words at[k] to at[k + 1]."""
    n, docs = len(w), len(at) - 1
    out = np.zeros(docs)
    if not n:
        return out
    doc = np.repeat(np.arange(docs), np.diff(at))
    low = 4.0 * (np.abs(w).sum() + 1)  # a text starts below all that was before
    sums = np.cumsum(w)
    before = sums - w
    gain = sums - np.minimum.accumulate(before - doc * low) - doc * low
    held = np.flatnonzero(np.diff(at))
    out[held] = np.maximum(np.maximum.reduceat(gain, at[:-1][held]), 0)
    return out


def maximal_segments(w: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score), by Ruzzo and Tompa's linear-time method."""
    found: list[tuple[int, int, float, float]] = []  # first, past, sum before, sum after
    total = 0.0
    for i, x in enumerate(w):
        before, total = total, total + x
        if x <= 0:
            continue
        first, left, right = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, i + 1, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - s) for a, b, s, r in found]


def _analyse(texts: pa.Array, model: Model):
    """For each block: (first row, words, best score, evidence, passages) of its texts."""
    for first, data, bounds in blocks(texts):
        numbers, at, start, end, *heads = words(data, bounds, IS_LETTER, PREFIXES)
        w = model.weights(numbers, heads, end - start)
        n = np.diff(at)
        best = best_segments(w, at)
        evidence = model.surprise(best, n)
        enough = -math.log(model.level)
        passages: list[list[tuple[int, int, float]]] = [[] for _ in n]
        for k in np.flatnonzero(evidence > enough).tolist():
            a = at[k]
            told = [(s, int(start[a + i] - bounds[k]), int(end[a + j - 1] - bounds[k])) for i, j, s in maximal_segments(w[a : at[k + 1]].tolist()) if model.surprise(s, n[k]) > enough]
            passages[k] = [(b, e, s) for s, b, e in told]
            evidence[k] = sum(model.surprise(s, n[k]) for s, _, _ in told) or evidence[k]
        yield first, n, best, evidence, passages


def _count_task(batches: Iterator[pa.RecordBatch]):
    """(key, toxic, total): the labelled documents that hold a word or beginning, added up in the task."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def out() -> pa.RecordBatch:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        y = np.concatenate([v for _, v in parts])
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(where, y, len(keys)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(keys)))], ["key", "toxic", "total"])

    for batch in batches:
        labels = batch.column(1).to_numpy()
        for first, data, bounds in blocks(batch.column(0)):
            numbers, at, start, end, *heads = words(data, bounds, IS_LETTER, PREFIXES)
            for k in range(len(bounds) - 1):
                a, b = at[k], at[k + 1]
                long = end[a:b] - start[a:b]
                keys = np.unique(np.concatenate([numbers[a:b], *(h[a:b][long > n] for n, h in zip(PREFIXES, heads, strict=True))]))
                parts.append((keys, np.full(len(keys), labels[first + k], np.int64)))
                held += len(keys)
            if held > 2_000_000:
                yield out()
                held = 0
    if parts:
        yield out()


def _evidence_task(batches: Iterator[pa.RecordBatch], model: Model, histogram: bool):
    """(y, n, best, evidence) of labelled documents, or (y, bin, count, 0) of the weights of clean ones."""
    for batch in batches:
        labels = batch.column(1).to_numpy()
        if histogram:
            for first, data, bounds in blocks(batch.column(0)):
                numbers, at, start, end, *heads = words(data, bounds, IS_LETTER, PREFIXES)
                w = model.weights(numbers, heads, end - start)[np.repeat(labels[first : first + len(bounds) - 1] == 0, np.diff(at))]
                bins, n = np.unique(np.round(w * 20).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(bins))), pa.array(bins.astype(float)), pa.array(n.astype(float)), pa.array(np.zeros(len(bins)))], ["y", "n", "best", "evidence"])
            continue
        for first, n, best, evidence, _ in _analyse(batch.column(0), model):
            yield pa.RecordBatch.from_arrays([pa.array(labels[first : first + len(n)].astype(float)), pa.array(n.astype(float)), pa.array(best), pa.array(evidence)], ["y", "n", "best", "evidence"])


_EVIDENCE = "y double, n double, best double, evidence double"


def _lambda(w: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum of share * exp(lambda w) = 1, by bisection."""
    p = n / n.sum()
    if not (w > 0).any() or (p * w).sum() >= 0:
        return 1.0  # as for a plain ratio of likelihoods
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * w, 500))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    b = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (y - p) - ridge * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, features: int = 200_000, least: int = 2, eligible: Column | None = None) -> Model:
    """Fits weights and calibration to about ``sample`` labelled documents, chosen by a hash of their id.

    Two thirds count towards the weights, one third towards the calibration. ``eligible``: which labels may be used.
    Only what ``least`` documents hold is kept, and of that the ``features`` most frequent, ties in the order of their
    keys. A null text is empty; null labels and ids teach nothing; of an id's labels the greatest counts. An id that
    several documents have gives them all its label. Without labels of both classes, or without documents, the model
    says that nothing is toxic. Other columns are ignored.
    """
    spark = docs.sparkSession
    on_workers(spark)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if eligible is not None:
        usable = usable.where(eligible)
    usable = usable.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    share = F.shiftrightunsigned(F.xxhash64("_id"), 1) / float(2**63)
    n = usable.count()
    picked = settle(usable.where(share < sample / max(n, 1)).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(3))), "toxicity-sample")
    told = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "_id")  # bounded by ``sample``
    told = settle(told.select("text", "y", "part"), "toxicity-texts")
    fit, judge = told.where("part < 2").select("text", "y"), told.where("part = 2").select("text", "y")
    facts = fit.agg(F.count("y").alias("n"), F.sum("y").alias("s")).first()
    total, toxic = facts["n"], facts["s"] or 0
    if not toxic or toxic == total:
        return Model(np.zeros(0, _U), np.zeros(0), np.zeros(0), 0.5, offset=-10.0)
    counts = fit.mapInArrow(_count_task, "key long, toxic long, total long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    counts = settle(counts.where(F.col("total") >= least), "toxicity-counts")
    if counts.count() > features:
        counts = counts.orderBy(F.desc("total"), "key").limit(features)
    table = counts.toArrow()  # at most ``features`` rows of three numbers
    keys = table.column("key").to_numpy().view(_U)
    order = np.argsort(keys)
    model = Model(keys[order], table.column("toxic").to_numpy()[order].astype(float), table.column("total").to_numpy()[order].astype(float), toxic / total)
    bins = judge.mapInArrow(lambda it: _evidence_task(it, model, True), _EVIDENCE).groupBy("n").agg(F.sum("best").alias("c")).toPandas()  # one row for each weight in steps of 1/20
    if not len(bins):
        return model
    model.lam = _lambda(bins["n"].to_numpy() / 20, bins["c"].to_numpy())

    def judged():
        rows = judge.mapInArrow(lambda it: _evidence_task(it, model, False), _EVIDENCE).toPandas()  # bounded by ``sample``
        return (rows[c].to_numpy() for c in ("y", "n", "best", "evidence"))

    y, n_words, best, _ = judged()
    clean = (y == 0) & (n_words > 0)
    if clean.any():
        model.k = float(clean.sum() / (n_words * np.exp(-model.lam * best))[clean].sum())
    y, _, _, evidence = judged()  # with K
    if 0 < y.sum() < len(y):
        model.slope, model.offset = _logistic(squeezed(evidence), y)
    return model


PASSAGES = "array<struct<start:long,stop:long,score:double>>"


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, best (of the maximum-scoring segment), n_words and passages.

    ``passages``: byte ranges of the significant segments in the UTF-8 text, with their scores. A null or empty text has
    no words and gets the score of no evidence. There is a row for each row; ids may be null or repeat. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(model)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]):
        m: Model = sent.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for first, n, best, evidence, passages in _analyse(batch.column(1), m):
                p = m.probability(evidence)
                told = [[{"start": b, "stop": e, "score": s} for b, e, s in x] for x in passages]
                arrays = [batch.column(0).slice(first, len(n)), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(best), pa.array(n.astype(np.int64)), pa.array(told, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "best", "n_words", "passages"])

    return chosen.mapInArrow(task, f"doc_id long, score double, predicted int, best double, n_words long, passages {PASSAGES}")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted to be toxic, with all their columns, in one pass and no join.

    A null or empty text has no evidence and stays, unless the labels make no evidence a sign. Rows are judged by their
    text alone, whatever their ids; equal texts have one fate. An empty table stays empty.
    """
    spark = docs.sparkSession
    on_workers(spark)
    sent, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first, n, _, evidence, _ in _analyse(batch.column(place), sent.value):
                yield batch.slice(first, len(n)).filter(pa.array(sent.value.probability(evidence) < threshold))

    return docs.mapInArrow(task, docs.schema)


def in_fold(id_col: str, fold: int, folds: int = 3) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
