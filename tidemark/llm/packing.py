"""Operator 1, packing: sum-of-squares online packing of tokenised documents into fixed windows.

Each scan task packs its own documents in one pass. A document is cut into full windows and a remainder; the remainder
goes to the fill level that makes the sum of squared counts of partially filled windows smallest (Csirik, Johnson,
Kenyon, Orlin, Shor and Weber, "On the sum-of-squares algorithm for bin packing"). The counts per fill level are one
array of ``window`` numbers. When a task ends, or holds more than ``max_open`` windows, the emptiest windows are poured
into the gaps of the fullest by cutting their pieces, and what is left at the very end is laid out in sequences whose
lengths are powers of two; so no sequence needs padding. There is no shuffle, and state is bounded by ``max_open``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import on_workers
from tidemark.llm.segments import encoder
from tidemark.llm.tokens import crc32_of, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class SumOfSquares:
    """Windows of ``window`` tokens. ``emit(sequence, pieces)`` is called once for each finished sequence."""

    def __init__(self, window: int, emit, max_open: int = 8192):
        self.window, self.emit, self.max_open = window, emit, max_open
        self.counts = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.next_sequence = 0

    def _finish(self, pieces: list[Piece]) -> None:
        self.emit(self.next_sequence, pieces)
        self.next_sequence += 1

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) whose choice makes the sum of squares smallest; ties go to the fullest.

        A window that becomes full leaves the sum.
        """
        top = self.window - size
        now = self.counts[1 : top + 1]
        after = self.counts[1 + size : self.window + 1].copy()
        after[-1:] = 0  # level ``window``: full, not counted
        change = 2 * (after - now) + 2
        change[-1:] -= 1
        change[now == 0] = np.iinfo(np.int64).max
        best_new = 2 * int(self.counts[size]) + 1
        if not len(change):
            return 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= best_new else 0

    def place(self, piece: Piece) -> None:
        size = len(piece.ids)
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self._put(level + size, pieces)
        if self.n_open > self.max_open:
            self.pour()

    def _put(self, level: int, pieces: list[Piece]) -> None:
        if level == self.window:
            self._finish(pieces)
        else:
            self.open[level].append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for at in range(0, full, self.window):
            self._finish([Piece(doc_id, at, ids[at : at + self.window], len(ids))])
        if full < len(ids):
            self.place(Piece(doc_id, full, ids[full:].copy(), len(ids)))

    def pour(self) -> None:
        """Fills the fullest windows from the emptiest ones until at most one window is open."""
        windows = [(level, w) for level in range(1, self.window) for w in self.open[level]]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0
        low, high = 0, len(windows) - 1
        source: list[Piece] = []
        while low <= high:
            level, pieces = windows[high]
            high -= 1
            while level < self.window and (source or low <= high):
                if not source:
                    source = windows[low][1][::-1]
                    low += 1
                piece, gap = source.pop(), self.window - level
                if len(piece.ids) > gap:
                    source.append(Piece(piece.doc_id, piece.start + gap, piece.ids[gap:], piece.doc_tokens))
                    piece = Piece(piece.doc_id, piece.start, piece.ids[:gap], piece.doc_tokens)
                pieces.append(piece)
                level += len(piece.ids)
            self._put(level, pieces)
        if source:
            self._put(sum(len(p.ids) for p in source), source[::-1])

    def close(self) -> None:
        """Ends the stream: pours, then lays the rest out in sequences whose lengths are powers of two."""
        while self.n_open > 1:
            before = self.n_open
            self.pour()
            if self.n_open >= before:
                break
        for level in range(1, self.window):
            for pieces in self.open[level]:
                rest = pieces[::-1]
                for bit in range(level.bit_length() - 1, -1, -1):
                    want, taken = level & 1 << bit, []
                    while want:
                        piece = rest.pop()
                        if len(piece.ids) > want:
                            rest.append(Piece(piece.doc_id, piece.start + want, piece.ids[want:], piece.doc_tokens))
                            piece = Piece(piece.doc_id, piece.start, piece.ids[:want], piece.doc_tokens)
                        taken.append(piece)
                        want -= len(piece.ids)
                    if taken:
                        self._finish(taken)


def _pack_task(batches: Iterator[pa.RecordBatch], path: str, byte_level: bool, window: int, end_id: int, max_open: int, keep_ids: bool):
    codec = encoder(path, byte_level)
    base = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []

    def emit(sequence: int, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            rows.append((p.doc_id, p.start, len(p.ids), crc32_of(p.ids), p.doc_tokens, base + sequence, at, p.ids if keep_ids else None))
            at += len(p.ids)

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if keep_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * keep_ids)

    packer = SumOfSquares(window, emit, max_open)
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, flat, bounds in codec.columns(batch.column(1)):
            flat, bounds = with_end(flat, bounds, end_id)
            for k in range(len(bounds) - 1):
                packer.add(doc_ids[first + k], flat[bounds[k] : bounds[k + 1]])
            if rows:
                yield out()
    packer.close()
    if rows:
        yield out()


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, byte_level: bool = False, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, max_open: int = 8192, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of a document in a training sequence.

    ``doc_id``, ``start`` and ``length`` (the piece in its document's ids), ``ids_crc32``, ``doc_tokens`` (with the end
    id), ``sequence_id`` and ``offset`` (the piece in its sequence); with ``keep_ids`` also ``ids``.

    A null or empty text is a document of one id, the end id. A null id stays null. Repeated rows and equal ids are
    separate documents. Texts of any length are cut at window ends. An empty table gives no rows. Other columns are
    ignored, whatever their names. ``sequence_id`` is unique over the table: task number times 2**32 plus a count.
    """
    on_workers(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(lambda it: _pack_task(it, tokenizer_path, byte_level, window, end_id, max_open, keep_ids), schema)
