"""Operator 9, exact dedup: an extendible-hash index on shared files, built and read with DataFrame operations alone.

1. Owner tasks compare bytes: rows are grouped by (64-bit key, text), so texts that collide in the key stay apart as a
   chain, and each scan task sends a text once however often it holds it (partial aggregation), which keeps a group of
   any size off a single task.
2. The directory: distinct keys are counted by their leading bits. Starting with one bucket, every bucket with more than
   ``bucket_size`` keys is split on its next bit, doubling the directory, until all fit or ``_DEPTH`` bits are used up.
   Copies do not count, and neither does a chain, so a bucket is overfull only by distinct keys. It has an entry for
   each prefix of as many bits as the deepest bucket has: a few for each bucket, and at most 2**_DEPTH, which is what
   makes it fit for a broadcast.
3. The index (bucket, key, place in the chain, digest, keep_id, group_size) is written to the shared folder, dealt and
   sorted by ranges of buckets.
4. A row finds its bucket in the directory, and in the bucket its key. Every row was there when the index was built, so
   the only entry of a key is the row's; of a chain, whose entries hold their texts, it is the one with the same bytes.
   Buckets with many rows, for example those of a large group of copies, are dealt to several tasks by a salt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, partitions, settle

_DEPTH = 20
_ROWS = 1 << 20  # rows of a bucket for each task that looks them up


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _cell(key: str, depth: int = _DEPTH) -> Column:
    """The ``depth`` leading bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each distinct text: key, digest, keep_id, group_size. Grouped by bytes, not by hash."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text(text_col).alias("text"))
    return (
        rows.withColumn("key", _key(F.col("text")))
        .groupBy("key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )


def directory(groups: DataFrame, bucket_size: int) -> tuple[DataFrame, int]:
    """(cell, depth, bucket, spread), and the global depth, which is that of cells: for each occupied cell its bucket's
    local depth, first cell (of all ``_DEPTH`` bits) and lookup tasks.

    Doubling proceeds depth by depth over counts per cell: a cell's bucket is the shortest prefix that holds at most
    ``bucket_size`` keys (or the whole cell). The counts of all depths come from one aggregation of the cells.
    """
    cells = settle(groups.select(_cell("key").alias("cell"), "group_size").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("rows")), "directory-cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    depths = [0]
    while total > bucket_size * 2 ** depths[-1] / 4 and depths[-1] < _DEPTH:
        depths.append(depths[-1] + 1)
    first = max(0, depths[-1] - 6)  # shallower buckets are overfull by far for keys that are spread by a hash
    fits = []
    for depth in range(first, depths[-1] + 1):
        prefix = F.shiftright("cell", _DEPTH - depth)
        fits.append(cells.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n")).where(F.col("n") <= bucket_size).select("prefix", F.lit(depth).alias("depth")))
    asked = cells.select("cell", "rows", F.explode(F.sequence(F.lit(first), F.lit(depths[-1]))).alias("depth"))
    asked = asked.withColumn("prefix", F.expr(f"shiftright(cell, {_DEPTH} - depth)"))
    found = asked.join(reduce(DataFrame.unionAll, fits).withColumn("fit", F.lit(1)), ["prefix", "depth"], "left")
    found = found.groupBy("cell", "rows").agg(F.coalesce(F.min(F.when(F.col("fit") == 1, F.col("depth"))), F.lit(_DEPTH)).alias("depth"))
    placed = found.select("cell", "rows", "depth", F.expr(f"shiftleft(shiftright(cell, {_DEPTH} - depth), {_DEPTH} - depth)").alias("bucket"))
    spread = placed.groupBy("bucket").agg(F.ceil(F.sum("rows") / _ROWS).cast("int").alias("spread"))
    placed = settle(placed.join(spread, "bucket").select("cell", "depth", "bucket", "spread"), "directory-placed")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    out = settle(placed.select(F.shiftright("cell", _DEPTH - deepest).alias("cell"), "depth", "bucket", "spread").distinct(), "directory")
    discard(cells, placed)
    return out, deepest


@dataclass
class Index:
    """``directory``: cell (of ``depth`` bits), depth, bucket, spread. ``entries``: bucket, depth, spread, key, chain, chain_length,
    text_sha256, keep_id, group_size, one for each distinct text. ``chained``: the entries of chains of two or more, with
    their text; None if there are none."""

    directory: DataFrame
    depth: int
    entries: DataFrame
    chained: DataFrame | None

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds ``bucket`` and ``spread`` to rows with a ``key``, as the directory has them."""
        return rows.withColumn("cell", _cell("key", self.depth)).join(F.broadcast(self.directory.select("cell", "bucket", "spread")), "cell").drop("cell")  # at most 2**_DEPTH entries

    @property
    def single(self) -> DataFrame:
        return self.entries.where("chain_length = 1")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_size: int = 50_000) -> Index:
    """Writes directory and entries to the shared folder."""
    groups = settle(_groups(docs, id_col, text_col), "text-groups")
    known, depth = directory(groups, bucket_size)
    placed = groups.withColumn("cell", _cell("key", depth)).join(F.broadcast(known), "cell").drop("cell")  # at most 2**_DEPTH entries
    placed = placed.repartitionByRange(partitions(docs.sparkSession), "bucket", "key")
    chain = Window.partitionBy("bucket", "key")
    placed = placed.withColumns({"chain": F.row_number().over(chain.orderBy("text_sha256")), "chain_length": F.count(F.lit(1)).over(chain)})
    entries = settle(placed.select("bucket", "depth", "spread", "key", "chain", "chain_length", "text_sha256", "keep_id", "group_size"), "text-index")
    discard(groups)
    chained = entries.where("chain_length > 1")
    if chained.isEmpty():
        return Index(known, depth, entries, None)
    texts = docs.select(_text(text_col).alias("text")).withColumn("key", _key(F.col("text")))
    texts = texts.join(chained.select("key").distinct(), "key", "left_semi").distinct().withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return Index(known, depth, entries, settle(chained.join(texts, ["key", "text_sha256"]), "text-chains"))


def mark_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_size: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. Of a group the row with the largest id stays. A null text counts as empty. A
    null id is never the one that stays, unless all ids of its group are null. Rows that repeat both id and text are
    one document: they all carry the same values, ``kept`` included. An empty table gives no rows. Other columns are
    ignored.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col, bucket_size=bucket_size)
    return look_up(docs, index, id_col=id_col, text_col=text_col)


def look_up(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``mark_exact_duplicates`` with an index of the same rows."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text(text_col).alias("text")).withColumn("key", _key(F.col("text")))
    salted = index.place(rows).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("spread")).cast("int"))
    dealt = lambda entries: entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).drop("spread", "depth").hint("merge")
    told = ["keep_id", "group_size", "text_sha256"]
    found = salted.select("doc_id", "bucket", "key", "salt").join(dealt(index.single), ["bucket", "key", "salt"]).select("doc_id", *told)
    if index.chained is not None:
        found = found.unionByName(salted.select("doc_id", "bucket", "key", "salt", "text").join(dealt(index.chained), ["bucket", "key", "salt", "text"]).select("doc_id", *told))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_size: int = 50_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    The row with the largest id stays; of rows that repeat that id and the text one stays. See ``mark_exact_duplicates``
    for null and empty texts, null ids and empty tables. The join key holds the id, so that a large group's rows spread
    over tasks.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col, bucket_size=bucket_size)
    taken = list(docs.columns)
    row, names = free_name(taken, "_row"), ["bucket", "key", "id", "unnamed"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in taken)).alias("doc"), _text(text_col).alias("text"), F.col(f"`{id_col}`").cast("long").alias("own_id"))
    whose = lambda c: {"id": F.coalesce(F.col(c), F.lit(0)), "unnamed": F.col(c).isNull()}
    rows = index.place(packed.withColumn("key", _key(F.col("text")))).withColumns(whose("own_id"))

    def kept(rows: DataFrame, entries: DataFrame, on: list[str]) -> DataFrame:
        found = rows.select("doc", *on).join(entries.withColumns(whose("keep_id")).select(*on).hint("merge"), on, "left_semi")
        one = Window.partitionBy(*on).orderBy(F.lit(1))
        return found.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select("doc")

    found = kept(rows, index.single, names)
    if index.chained is not None:
        found = found.unionByName(kept(rows, index.chained, [*names, "text"]))
    return found.select(*(F.col("doc").getField(c).alias(c) for c in taken))
