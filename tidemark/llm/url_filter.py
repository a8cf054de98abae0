"""Operator 6, URL filters: rules first, then gradient-boosted trees on lexical features, in DataFrame operations alone.

Labelled URLs are turned into small integers (feature bins), equal rows are added up, and each level of splits of each
tree is one aggregation of gradients by (node, feature, bin) over that table; the leaves are the sums of the last splits.
The trees become one SQL expression, so scoring runs inside the scan of the URLs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, settings, settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path prefix in one, as in ``net/de/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, or null; of equally long ones the first in text order."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    return reduce(lambda out, r: F.when(rule == r.text, F.lit(r.verdict)).otherwise(out), rules, F.lit(None).cast("string"))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return -F.aggregate(chars, F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c)))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _count(url, "0123456789") / n,
        "mark_ratio": _count(url, "-_.~%&=+") / n,
        "hyphens": _count(host, "-"),
        "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")),
        "fragment": F.instr(url, "#").cast("boolean").cast("int"),
        "host_entropy": F.round(_entropy(host), 6),
        "path_entropy": F.round(_entropy(path), 6),
    }


@dataclass
class Model:
    """Trees as nested tuples (feature, bin, left, right) or leaf values; ``edges``: upper bounds of each feature's bins."""

    base: float
    edges: dict[str, list[float]]
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None

    def margin(self, bins: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, at, left, right = node
            return F.when(bins[name] <= at, walk(left)).otherwise(walk(right))

        return reduce(lambda a, t: a + walk(t), self.trees, F.lit(float(self.base)))


def _bin(value: Column, edges: list[float]) -> Column:
    """How many of the sorted edges lie below the value."""
    return reduce(lambda a, e: a + (value > float(e)).cast("int"), edges, F.lit(0))


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def _suffix_stats(sample: DataFrame, weight: float = 20.0) -> DataFrame:
    """Share of blocked URLs by suffix, drawn towards the share of all; at most a row for each sampled URL."""
    total = sample.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("p"))
    return sample.groupBy("suffix").agg(F.sum(F.col("y") * F.col("w")).alias("s"), F.sum("w").alias("n")).crossJoin(F.broadcast(total)).select("suffix", ((F.col("s") + weight * F.col("p")) / (F.col("n") + weight)).alias("rate"))


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "blocked", sample: int = 20_000, rounds: int = 8, depth: int = 3, bins: int = 12, rate: float = 0.4, ridge: float = 1.0, min_rows: float = 5.0) -> Model:
    """Fits trees to (url, 0 or 1). At most ``sample`` distinct labelled URLs are used, those with the smallest hashes.

    A URL counts as often as it is labelled, however many rows repeat it. Rows without a label are passed by, a null URL
    is an empty one. Without labels the model's margin is -4 everywhere, with labels of one class it is that class. Of
    equally good splits the first feature in order and the least bin wins. Other columns are ignored.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    picked = labelled.select(url.alias("url"), F.col(f"`{label_col}`").cast("double").alias("y")).where("y is not null")
    picked = picked.groupBy("url", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).orderBy(F.xxhash64("url"), "url", "y").limit(sample)
    picked = picked.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("suffix", _suffix(F.col("host")))
    picked = settle(picked.select("*", *(c.cast("double").alias(k) for k, c in lexical_features(F.col("url"), F.col("host"), F.col("path")).items())), "url-sample")
    names = [c for c in picked.columns if c not in ("url", "y", "w", "host", "path", "suffix")]
    suffixes = settle(_suffix_stats(picked), "url-suffixes")
    told = picked.join(F.broadcast(suffixes), "suffix").withColumnRenamed("rate", "suffix_rate")  # at most ``sample`` rows
    names.append("suffix_rate")
    cuts = [k / bins for k in range(1, bins)]
    facts = told.agg(F.sum("w").alias("n"), F.sum(F.col("y") * F.col("w")).alias("s"), *(F.percentile_approx(c, cuts, 10_000).alias(c) for c in names)).first()
    n, s = facts["n"], facts["s"] or 0.0
    edges = {c: sorted(set(facts[c] or [])) for c in names}
    if not n:
        return Model(-4.0, edges, [], suffixes)
    share = min(max(s / n, 1e-4), 1 - 1e-4)
    model = Model(math.log(share / (1 - share)), edges, [], suffixes)
    if s in (0, n):
        return model
    table = told.select((F.col("y") * F.col("w")).alias("y"), "w", *(_bin(F.col(c), edges[c]).alias(c) for c in names)).groupBy(*names).agg(F.sum("y").alias("y"), F.sum("w").alias("w"))
    table = settle(table.coalesce(1), "url-bins")  # at most ``sample`` rows of small integers
    # Plans over so few rows are not worth compiling, splitting or planning twice.
    with settings(table.sparkSession, spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN", spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="1"):
        for _ in range(rounds):
            model.trees.append(_grow(table, names, model, depth, rate, ridge, min_rows))
    discard(picked, table)
    return model


def _grow(table: DataFrame, names: list[str], model: Model, depth: int, rate: float, ridge: float, min_rows: float):
    p = 1 / (1 + F.exp(-model.margin({c: F.col(c) for c in names})))
    rows = table.select(*names, p.alias("p"), "y", "w").select(*names, (F.col("y") - F.col("w") * F.col("p")).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"), "w")
    splits: dict[int, tuple[str, int] | None] = {}
    leaves: dict[int, float] = {}

    def node_of() -> Column:
        """Nodes are numbered as in a heap, from 1."""

        def walk(k: int) -> Column:
            if not splits.get(k):
                return F.lit(k)
            name, at = splits[k]
            return F.when(F.col(name) <= at, walk(2 * k)).otherwise(walk(2 * k + 1))

        return walk(1)

    for level in range(depth):
        cells = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(c).alias("b")) for k, c in enumerate(names))))
        sums = rows.select(node_of().alias("node"), "g", "h", "w", cells.alias("x")).where(F.col("node") >= 2**level)
        found = sums.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("w").alias("w")).collect()  # nodes x features x bins
        by: dict[int, list[list]] = {}
        for r in found:
            by.setdefault(r["node"], [[] for _ in names])[r["f"]].append((r["b"], r["g"], r["h"], r["w"]))
        for node, features in by.items():
            g, h, w = (sum(x[k] for x in features[0]) for k in (1, 2, 3))
            leaves[node] = rate * g / (h + ridge)
            best = (1e-6, None, 0.0, 0.0)
            for name, cells_of in zip(names, features, strict=True):
                gl = hl = wl = 0.0
                for b, g_, h_, w_ in sorted(cells_of)[:-1]:
                    gl, hl, wl = gl + g_, hl + h_, wl + w_
                    if min(wl, w - wl) < min_rows:
                        continue
                    gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, b), gl, hl)
            splits[node] = best[1]
            if best[1]:
                leaves[2 * node], leaves[2 * node + 1] = rate * best[2] / (best[3] + ridge), rate * (g - best[2]) / (h - best[3] + ridge)
        if not any(splits.get(k) for k in by):
            break

    def build(k: int):
        return (*splits[k], build(2 * k), build(2 * k + 1)) if splits.get(k) else leaves[k]

    return build(1)


def score(urls: DataFrame, model: Model, *, url_col: str = "url", out: str = "block_score") -> DataFrame:
    """Adds ``out``, the model's probability that a URL is to be blocked; all rows and columns stay.

    A null URL is scored as an empty one, equal URLs get equal scores, however long they are. ``out`` takes another name
    if a column has it. An empty table stays empty.
    """
    taken = list(urls.columns)
    temp = {n: free_name(taken, f"_{n}") for n in ("host", "path", "suffix", "x", "rate")}
    url = F.col(f"`{url_col}`")
    rows = urls.withColumns({temp["host"]: host_of(url), temp["path"]: path_of(url)}).withColumn(temp["suffix"], _suffix(F.col(temp["host"])))
    features = lexical_features(url, F.col(temp["host"]), F.col(temp["path"]))
    if model.trees:
        stats = F.broadcast(model.suffixes.select(F.col("suffix").alias(temp["suffix"]), F.col("rate").alias(temp["rate"])))  # bounded by train()'s ``sample``
        rows = rows.join(stats, temp["suffix"], "left")
        prior = 1 / (1 + math.exp(-model.base))
        features["suffix_rate"] = F.coalesce(F.col(temp["rate"]), F.lit(prior))
    else:
        rows = rows.withColumn(temp["rate"], F.lit(None).cast("double"))
    rows = rows.withColumn(temp["x"], F.struct(*(_bin(c.cast("double"), model.edges.get(k, [])).alias(k) for k, c in features.items())))
    margin = model.margin({k: F.col(temp["x"])[k] for k in features})
    return rows.select(*(F.col(f"`{c}`") for c in taken), (1 / (1 + F.exp(-margin))).alias(free_name(taken, out)))


def filter_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5, **training) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_score.

    The longest fitting rule decides; URLs that no rule fits get the model's verdict. The model learns from ``labelled``
    (url, blocked), or else from the URLs that rules decide. A null URL, or one without ``://``, has an empty host and
    path. Ids may be null or repeat. An empty table gives no rows. Other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    ruled = verdict_of(F.col("rule"), rules)
    if labelled is None:
        labelled = rows.where("rule is not null").select("url", (ruled == "block").cast("int").alias("blocked"))
        model = train(labelled, **training)
    else:
        model = train(labelled, **training)
    scored = score(rows, model)
    judged = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(ruled, judged).alias("verdict"), "block_score")
