"""Operator 8, SentencePiece: a model file rebuilt on the tokenizers library, with parity checked against the original.

The protobuf is read field by field. From it come the normaliser (character map, blanks, the marker U+2581 and its dummy
prefix), the model (unigram scores, or merges in the order of their scores), byte fallback and the decoder. Texts are
encoded word by word where no piece holds the marker after another character, else whole, in batches on several threads.
Every whole text is also encoded by the SentencePiece library and compared.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import on_workers
from tidemark.llm.tokens import WordMemo, crc32_of, text_batches

MARK = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of a protobuf message's fields: integers, eight or four bytes, or bytes."""

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            n = varint()
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unknown: int = 0


def read_model(path: str) -> PieceModel:
    out = PieceModel()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in wire_fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire_fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                out.unknown = len(out.pieces)
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire_fields(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in wire_fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
    return out


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """All pairs of pieces whose join is a piece, the best-scored piece first."""
    vocab = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, k in vocab.items():
        for cut in range(1, len(piece)):
            left, right = vocab.get(piece[:cut]), vocab.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[k][1], left, right, piece[:cut], piece[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: PieceModel):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = model.pieces[model.unknown][0]
    if model.kind == BPE:
        backend = models.BPE({p: k for k, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        backend = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        raise ValueError("word and character models are not supported")
    tokenizer = Tokenizer(backend)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encodes with the rebuilt tokenizer, compares with the original library, decodes."""

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = read_model(path)
        self.tokenizer = build(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.by_word = self.model.dummy_prefix and not self.model.squeeze and not self.model.charsmap and all(MARK not in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))
        self.memo = WordMemo(self._encode, "", "", self._encode)
        table = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.length = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, bounds, which whole texts agree with the original library)."""
        if self.by_word:
            flat, bounds = self.memo.encode(texts)
        else:
            ids = self._encode(texts)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(bounds[-1]))
        told = self.original.encode(texts, num_threads=self.threads)
        agree = np.fromiter((b - a == len(x) and flat[a:b].tolist() == x for a, b, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), told, strict=True)), bool, len(texts))
        return flat, bounds, agree

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text: its pieces' bytes, the marker as a blank, without the dummy prefix."""
        n = self.length[flat]
        ends = np.cumsum(n)
        data = self.bytes[np.repeat(self.start[flat] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[bounds].tolist()
        skip = int(self.model.dummy_prefix)
        return [data[a + skip : b] if a < b else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


_LOADED: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = 2) -> Codec:
    """The codec of a model file, kept for the life of the worker."""
    if (path, threads) not in _LOADED:
        _LOADED[path, threads] = Codec(path, threads)
    return _LOADED[path, threads]


def _encode_task(batches: Iterator[pa.RecordBatch], path: str, threads: int, keep_ids: bool):
    c = codec(path, threads)
    for batch in batches:
        for first, texts in text_batches(batch.column(1).to_pylist()):
            flat, bounds, agree = c.encode(texts)
            same = [a == t.encode() for a, t in zip(c.decode(flat, bounds), texts, strict=True)]
            crc = [crc32_of(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            arrays = [batch.column(0).slice(first, len(texts)), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(agree), pa.array(same)]
            if keep_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"] + ["ids"] * keep_ids)


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity (the ids of the whole text equal those of the original library), round_trip (decoding gives the text).

    A null or empty text has no ids; it is in parity and round-trips to the empty text. There is a row for each row; ids
    may be null or repeat. An empty table gives no rows. Other columns are ignored.
    """
    on_workers(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(lambda it: _encode_task(it, model_path, threads, keep_ids), schema)


def _decode_task(batches: Iterator[pa.RecordBatch], path: str):
    c = codec(path)
    for batch in batches:
        ids = [np.asarray(x or [], np.uint32) for x in batch.column(1).to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        texts = [t.decode("utf-8", "replace") for t in c.decode(np.concatenate([np.zeros(0, np.uint32), *ids]), bounds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_documents(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    on_workers(encoded.sparkSession)
    chosen = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return chosen.mapInArrow(lambda it: _decode_task(it, model_path), "doc_id long, text string")
