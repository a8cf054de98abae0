"""Operator 2, language identification: Bayesian fusion of text, declared markup language, address suffix and host.

1. Text: log-likelihoods of each language from word beginnings, counted on labelled documents; a text counts as at most
   ``evidence_words`` independent words.
2. Declared language: how often each declaration stands over each language, as judged by text, with Dirichlet smoothing.
3. Host: the languages of a host's texts, drawn towards those of its domain, those towards the suffix's and those
   towards all, by one grouped aggregation for each level; a row's own share is left out of what it is judged by.

The posterior is the normalised product. Only the likelihoods are computed in Python; a row is then its identifiers and
one number for each language, and the rest is aggregations and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_parts, on_workers, settle
from tidemark.llm.shingles import IS_LETTER, blocks, words

_U = np.uint64
PREFIXES = (2, 4)
# Elements whose content is no text of the page.
_HIDDEN = {name: (re.compile(rf"<{name}\b"), re.compile(rf"</{name}\s*>")) for name in ("script", "style", "nav", "footer")}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class TextModel:
    languages: list[str]
    keys: np.ndarray  # sorted numbers of word beginnings
    gains: np.ndarray  # log-probability of each in each language, less the mean over languages
    evidence_words: float = 40.0

    def likelihoods(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, log-likelihood of each language for each text), block by block; zeros for a text without words."""
        for first, data, bounds in blocks(texts):
            numbers, at, start, end, *heads = words(data, bounds, IS_LETTER, PREFIXES)
            out = np.zeros((len(bounds) - 1, len(self.languages)))
            if len(self.keys) and len(numbers):
                key = np.where(end - start > PREFIXES[1], heads[1], numbers)
                _, one, back = np.unique(key, return_index=True, return_inverse=True)
                gains = np.zeros((len(one), len(self.languages)))
                done = np.zeros(len(one), bool)
                for level in (key, heads[0]):
                    k = level[one]
                    where = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                    found = (self.keys[where] == k) & ~done
                    gains[found] = self.gains[where[found]]
                    done |= found
                held = np.flatnonzero(np.diff(at))
                sums = np.add.reduceat(gains[back], at[:-1][held], axis=0)
                n = np.diff(at)[held]
                out[held] = sums * np.minimum(1, self.evidence_words / n)[:, None]
            yield first, out


def _count_task(batches: Iterator[pa.RecordBatch], languages: list[str]):
    """(key, n_0, n_1, ...): words of each language by beginning."""
    place = {x: k for k, x in enumerate(languages)}
    for batch in batches:
        lang = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
        for first, data, bounds in blocks(batch.column(0)):
            numbers, at, start, end, *heads = words(data, bounds, IS_LETTER, PREFIXES)
            of = np.repeat(lang[first : first + len(bounds) - 1], np.diff(at))
            key = np.concatenate([np.where(end - start > PREFIXES[1], heads[1], numbers), heads[0]])
            of = np.concatenate([of, of])
            key, of = key[of >= 0], of[of >= 0]
            if len(key):
                unique, back = np.unique(key, return_inverse=True)
                n = np.bincount(back * len(languages) + of, minlength=len(unique) * len(languages)).reshape(-1, len(languages))
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *(pa.array(n[:, k]) for k in range(len(languages)))], ["key"] + [f"n{k}" for k in range(len(languages))])


def train(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", sample: int = 20_000, features: int = 200_000) -> TextModel:
    """Counts word beginnings in about ``sample`` labelled texts, chosen by a hash of the text.

    Keeps the ``features`` most frequent, ties in the order of their keys. Every label is a language; null labels teach
    nothing, a null text is empty, and copies of a text are in the sample together or not at all. Without labels, or with
    an empty table, the model has no languages. Other columns are ignored.
    """
    spark = labelled.sparkSession
    on_workers(spark)
    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("string").alias("lang")).where("lang is not null")
    by = rows.groupBy("lang").count().collect()  # a row for each language
    languages, total = sorted(r["lang"] for r in by), sum(r["count"] for r in by)
    if not languages:
        return TextModel([], np.zeros(0, _U), np.zeros((0, 0)))
    share = F.shiftrightunsigned(F.xxhash64("text"), 1) / float(2**63)
    names = [f"n{k}" for k in range(len(languages))]
    counts = rows.where(share < sample / total).mapInArrow(lambda it: _count_task(it, languages), ", ".join(["key long", *(f"{n} long" for n in names)]))
    counts = counts.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).withColumn("n", sum((F.col(n) for n in names), F.lit(0)))
    counts = settle(counts.where("n > 2"), "language-counts")
    if counts.count() > features:
        counts = counts.orderBy(F.desc("n"), "key").limit(features)
    table = counts.toArrow()  # at most ``features`` rows
    keys = table.column("key").to_numpy().view(_U)
    order = np.argsort(keys)
    n = np.column_stack([table.column(c).to_numpy() for c in names]).astype(float)[order] if len(keys) else np.zeros((0, len(names)))
    logs = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(len(keys), 1)))
    return TextModel(languages, keys[order], logs - logs.mean(axis=1, keepdims=True))


def visible_text(html: str | None) -> str:
    """The text outside of tags, comments and hidden elements, in one pass: what has no end is looked for only once.

    A hidden element that is not closed loses its tag alone, an open comment is a tag, and an open tag is text.
    """
    html = html or ""
    low, out, at, endless = html.translate(_LOWER), [], 0, set()
    while (start := html.find("<", at)) >= 0:
        stop = -1
        if html.startswith("<!--", start) and "<!--" not in endless:
            stop = html.find("-->", start + 4) + 3
            if stop < 3:
                endless.add("<!--")
                stop = -1
        else:
            for name, (opened, closed) in _HIDDEN.items():
                if low.startswith(name, start + 1) and opened.match(low, start) and name not in endless:
                    found = closed.search(low, start)
                    if found:
                        stop = found.end()
                    else:
                        endless.add(name)
        if stop < 0:
            stop = html.find(">", start) + 1
            if not stop:
                break
        out += html[at:start], " "
        at = stop
    return "".join([*out, html[at:]])


def declared_language(html: Column) -> Column:
    """The primary language of the html tag's lang attribute or of a content-language header, in lower case, or null."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    head = F.regexp_extract(html, r"(?i)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.lower(F.when(tag != "", tag).when(head != "", head))


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, its last two labels, its last label) of a URL, in lower case; null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0), F.regexp_extract(host, r"[^.]*$", 0)


def _likelihood_task(batches: Iterator[pa.RecordBatch], model: TextModel, html: bool):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for k, n in byte_parts(texts):
            part = texts.slice(k, n)
            shown = pa.array([visible_text(t) for t in part.to_pylist()], pa.string()) if html else part
            for first, out in model.likelihoods(shown):
                rows = [c.slice(k + first, len(out)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(list(out), pa.list_(pa.float64()))], [*batch.schema.names[:-1], "text_log"])


def text_evidence(rows: DataFrame, model: TextModel, text: Column, html: bool, **columns: Column) -> DataFrame:
    """The given columns and ``text_log``, an array with a log-likelihood for each language."""
    spark = rows.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(model)
    chosen = rows.select(*(c.alias(k) for k, c in columns.items()), F.coalesce(text, F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(lambda it: _likelihood_task(it, sent.value, html), f"{schema}, text_log array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def fuse(evidence: DataFrame, languages: list[str], *, weight: float = 10.0, reliability: float = 1.0) -> DataFrame:
    """Adds ``lang``, ``confidence`` and ``text_lang`` to rows with text_log, declared, host, domain and suffix (may be null).

    What is counted by host, domain, suffix and declaration is written to the shared folder, so that adaptive execution
    can split the rows of a common one; rows that have none are dealt by a hash, not by null. ``weight``: rows that a level's prior counts as; ``reliability``: the smoothing of declarations. A row without any
    evidence gets the language that is most frequent by text. Ties go to the language first in order.
    """
    m = len(languages)
    rows = evidence.withColumn("text_p", _softmax(F.col("text_log")))
    p = [F.col("text_p")[k] for k in range(m)]
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(p)]
    total = rows.agg(*sums)
    vector = lambda: F.array(*(F.col(f"s{k}") for k in range(m)))
    total = F.broadcast(total.select(F.transform(vector(), lambda x: (x + 1.0) / F.aggregate(vector(), F.lit(float(m)), lambda a, y: a + y)).alias("prior")))  # one row
    rows = rows.crossJoin(total)

    def with_counts(rows: DataFrame, level: str, found: DataFrame) -> DataFrame:
        # No level's name has this mark, so rows without one find nothing.
        nobody = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("text_log", *(c for c in ("doc_id", "page_id") if c in rows.columns)), F.lit(997)).cast("string"))
        keyed = rows.withColumn("_level", F.coalesce(F.col(level), nobody))
        return keyed.join(found.withColumnRenamed(level, "_level").hint("merge"), "_level", "left").drop("_level")

    for level in ("suffix", "domain", "host"):
        seen = evidence.withColumn("text_p", _softmax(F.col("text_log")))
        found = settle(seen.where(F.col(level).isNotNull()).groupBy(level).agg(*sums).select(level, vector().alias("seen")), f"language-{level}")
        rows = with_counts(rows, level, found)
        others = F.zip_with(F.col("seen"), F.col("text_p"), lambda s, x: F.greatest(s - x, F.lit(0.0)))
        n = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        drawn = F.zip_with(others, F.col("prior"), lambda o, q: o + weight * q)
        rows = rows.withColumn("prior", F.when(F.col("seen").isNull(), F.col("prior")).otherwise(F.transform(drawn, lambda x: x / (n + weight)))).drop("seen")
    told = evidence.withColumn("text_p", _softmax(F.col("text_log"))).where("declared is not null").groupBy("declared").agg(*sums).select("declared", vector().alias("by_lang"))
    base = told.agg(*(F.sum(F.col("by_lang")[k]).alias(f"s{k}") for k in range(m))).select(vector().alias("all_lang"))
    told = told.crossJoin(F.broadcast(base)).select("declared", F.zip_with("by_lang", "all_lang", lambda x, a: F.log((x + reliability) / (a + reliability * m))).alias("declared_log"))
    rows = with_counts(rows, "declared", settle(told, "language-declared"))
    zero = F.array_repeat(F.lit(0.0), m)
    logs = F.zip_with(F.col("text_log"), F.coalesce("declared_log", zero), lambda a, b: a + b)
    logs = F.zip_with(logs, F.col("prior"), lambda a, q: a + F.log(q))
    rows = rows.withColumn("p", _softmax(logs))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return rows.withColumns({"lang": best(F.col("p")), "confidence": F.array_max("p"), "text_lang": best(F.col("text_p"))})


def identify(documents: DataFrame, pages: DataFrame | None = None, **training) -> DataFrame:
    """One row for each document and page: doc_id, page_id (null in the other table's rows), lang, confidence, text_lang, declared.

    Documents (doc_id, text, lang, source) teach the text model; their source stands for a host, and their label is no
    evidence of their own. Pages (page_id, url, html) bring markup, suffix and host. Null or empty texts are judged by
    the rest. Repeated rows get equal results. Without labelled documents, ``lang`` is null everywhere.
    """
    model = train(documents, **training)
    none = F.lit(None).cast("string")
    long = lambda c: F.col(c).cast("long")
    parts = [text_evidence(documents, model, F.col("text"), False, doc_id=long("doc_id"), page_id=F.lit(None).cast("long"), declared=none, host=F.concat(F.lit("source:"), F.col("source")), domain=none, suffix=none)]
    if pages is not None:
        host, domain, suffix = host_parts(F.col("url"))
        parts.append(text_evidence(pages, model, F.col("html"), True, doc_id=F.lit(None).cast("long"), page_id=long("page_id"), declared=declared_language(F.col("html")), host=host, domain=domain, suffix=suffix))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not model.languages:
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared")
    rows = settle(rows, "language-evidence")
    return fuse(rows, model.languages).select("doc_id", "page_id", "lang", "confidence", "text_lang", "declared")
