"""Operator 10, media columns: bytes carried losslessly in MPEG audio files, and a parser of such files.

Encoder: an ID3v2.3 tag with the payload's length, a frame with a variable-bitrate table (``Xing``: frames, bytes, 100
seek points), then one MPEG-1 Layer III frame for each 192 bytes of payload: 80 kbit/s, 48 kHz, mono, protected by the
frame's CRC-16, its side information all zero (two silent granules), the payload and its CRC-32 as ancillary data; an
ID3v1 tag ends the file. A player hears silence; the bytes come back whole.

Parser: skips and reads tags, finds the first two agreeing frame headers, walks the frames, resynchronises after
anything that is no frame, checks each CRC-16, reads the variable-bitrate table, and gives the exact duration (samples
over sample rate) and the offset of every frame. Its time grows as the file does, whatever the bitrates. It reads any
file; one that holds no payload of ours, or no audio at all, has nulls for what it lacks. The media table keeps the exact
duration and the frames' offsets, as runs of equal steps, beside each file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_parts, on_workers, settle

UNIT = 192

# Fixed values of the format (ISO/IEC 11172-3): kbit/s by index for layers I, II, III; sample rates; generator.
_BITRATES = {
    1: [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    2: [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    3: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
}
_LOW_BITRATES = {1: [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
_RATES = [44100, 48000, 32000]
_POLYNOMIAL = 0x8005


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for k in range(256):
        c = k << 8
        for _ in range(8):
            c = (c << 1 ^ (_POLYNOMIAL if c & 0x8000 else 0)) & 0xFFFF
        table[k] = c
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, as frames carry it."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25 (MPEG 2.5)
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)


def read_header(b: bytes) -> Header | None:
    """The header in four bytes, or None if they are none (free bitrate counts as none)."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(b[1] >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(b[1] >> 1 & 3)
    bitrate, rate, padding = b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1
    if version is None or layer is None or bitrate in (0, 15) or rate == 3:
        return None
    kbps = (_BITRATES[layer] if version == 1 else _LOW_BITRATES[1 if layer == 1 else 2])[bitrate]
    hz = _RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    return Header(version, layer, not b[1] & 1, kbps, hz, 1 if b[3] >> 6 == 3 else 2, length, samples)


_HEAD = bytes([0xFF, 0xFA, 0x64, 0xC4])
_FRAME = read_header(_HEAD)
assert _FRAME and (_FRAME.length, _FRAME.side) == (240, 17)
_AT = 4 + 2 + _FRAME.side  # of the payload in its frame


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        text = b"\x00" + k.encode("latin-1") + b"\x00" + v.encode("latin-1")
        body += b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(body)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def encode(data: bytes) -> bytes:
    """An MPEG audio file that holds ``data`` (padded with blanks to a positive multiple of 192 bytes) and its length."""
    n = max(1, -(-len(data) // UNIT))
    frames = np.zeros((n + 1, _FRAME.length), np.uint8)
    frames[:, :4] = np.frombuffer(_HEAD, np.uint8)
    check = int(crc16(frames[:1, [2, 3, *range(6, 6 + _FRAME.side)]])[0])
    frames[:, 4], frames[:, 5] = check >> 8, check & 255
    body = np.full(n * UNIT, 32, np.uint8)
    body[: len(data)] = np.frombuffer(data, np.uint8)
    frames[1:, _AT : _AT + UNIT] = body.reshape(n, UNIT)
    raw = body.tobytes()
    checks = np.fromiter((zlib.crc32(raw[k : k + UNIT]) for k in range(0, len(raw), UNIT)), ">u4", n)
    frames[1:, _AT + UNIT : _AT + UNIT + 4] = checks.view(np.uint8).reshape(n, 4)
    seek = bytes(min(255, 256 * (1 + n * k // 100) // (n + 1)) for k in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, (n + 1) * _FRAME.length) + seek
    frames[0, _AT : _AT + len(xing)] = np.frombuffer(xing, np.uint8)
    return _tag({"payload": str(len(data))}) + frames.tobytes() + b"TAG" + b"payload".ljust(124, b"\x00") + b"\xff"


@dataclass
class Audio:
    """What a file holds. ``offsets``: of each audio frame, the table's frame left out. ``samples``: of those frames."""

    tags: dict[str, str] = field(default_factory=dict)
    header: Header | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    kbps: set[int] = field(default_factory=set)
    bad_checks: int = 0
    resyncs: int = 0
    skipped: int = 0
    vbr: dict | None = None
    id3v1: bool = False

    @property
    def seconds(self) -> float:
        return self.samples / self.header.rate if self.header else 0.0


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}  # fixed values of the tag format


def _text_field(body: bytes) -> list[str]:
    """The strings of a text field, which its first byte tells the encoding of."""
    kind = _ENCODINGS.get(body[0]) if body else None
    return [] if kind is None else body[1:].decode(kind, "replace").replace("\ufeff", "").split("\x00")


def _read_tags(buf: bytes, audio: Audio) -> tuple[int, int]:
    at, end = 0, len(buf)
    while buf[at : at + 3] == b"ID3" and at + 10 <= end:
        major, size = buf[at + 3], sum((x & 127) << s for x, s in zip(buf[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        p, stop = at + 10, min(end, at + 10 + size)
        if buf[at + 5] & 64 and p + 4 <= stop:  # an extended header; in version 4 its size counts itself
            n = buf[p : p + 4]
            p += sum((x & 127) << s for x, s in zip(n, (21, 14, 7, 0), strict=True)) if major == 4 else 4 + struct.unpack(">I", n)[0]
        while major in (3, 4) and p + 10 <= stop and buf[p]:
            k, n = buf[p : p + 4].decode("latin-1"), struct.unpack(">I", buf[p + 4 : p + 8])[0]
            if major == 4:
                n = sum((x & 127) << s for x, s in zip(buf[p + 4 : p + 8], (21, 14, 7, 0), strict=True))
            body, p = buf[p + 10 : min(stop, p + 10 + n)], p + 10 + n
            told = _text_field(body) if k[0] == "T" else []
            if k == "TXXX" and len(told) > 1:
                audio.tags[told[0]] = told[1]
            elif told and k != "TXXX":
                audio.tags[k] = told[0]
        at += 10 + size + 10 * bool(buf[at + 5] & 16)
    if end - at >= 128 and buf[end - 128 : end - 125] == b"TAG":
        audio.id3v1, end = True, end - 128
        audio.tags.setdefault("title", buf[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    return min(at, end), end


def _read_table(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + h.side
    for start in {at, at - 2 * h.protected}:
        if frame[start : start + 4] in (b"Xing", b"Info"):
            out: dict = {"kind": frame[start : start + 4].decode()}
            flags, p = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and p + 4 <= len(frame):
                    out[name], p = struct.unpack(">I", frame[p : p + 4])[0], p + 4
            if flags & 4:
                out["seek"], p = list(frame[p : p + 100]), p + 100
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        return {"kind": "VBRI", "bytes": struct.unpack(">I", frame[46:50])[0], "frames": struct.unpack(">I", frame[50:54])[0]}
    return None


def _kin(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def parse(buf: bytes) -> Audio:
    """Reads a file; junk between frames is skipped and counted, a cut last frame is junk."""
    audio = Audio()
    at, end = _read_tags(buf, audio)
    bytes_ = np.frombuffer(buf, np.uint8)
    offsets: list[np.ndarray] = []
    synced = first = True
    while at + 4 <= end:
        h = read_header(buf[at : at + 4])
        whole = h is not None and at + h.length <= end
        if whole and not (synced and audio.header and _kin(h, audio.header)):  # else it counts if its like or the end follows
            whole = at + h.length == end or _kin(h, read_header(buf[at + h.length : at + h.length + 4]))
        if not whole:
            audio.resyncs += synced
            synced = False
            found = buf.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            audio.skipped += found - at
            at = found
            continue
        most, n, step = max(1, (end - at) // h.length), 1, 8
        while n < most:  # frames of the same header, looked for in growing steps
            ahead = bytes_[at + n * h.length : at + min(most, n + step) * h.length].reshape(-1, h.length)
            same = (ahead[:, :4] == bytes_[at : at + 4]).all(axis=1)
            n += len(same) if same.all() else int(np.argmin(same))
            if not same.all():
                break
            step *= 2
        rows = bytes_[at : at + n * h.length].reshape(n, h.length)
        if h.protected and h.layer == 3:
            stated = rows[:, 4].astype(np.uint16) << 8 | rows[:, 5]
            audio.bad_checks += int((crc16(rows[:, [2, 3, *range(6, 6 + h.side)]]) != stated).sum())
        skip = 0
        if first:
            audio.header, first = h, False
            audio.vbr = _read_table(buf[at : at + h.length], h)
            skip = int(audio.vbr is not None)
        offsets.append(at + h.length * np.arange(skip, n, dtype=np.int64))
        audio.samples += h.samples * (n - skip)
        audio.kbps.add(h.kbps)
        at, synced = at + n * h.length, True
    audio.skipped += end - at if at < end else 0
    audio.offsets = np.concatenate(offsets) if offsets else audio.offsets
    return audio


def holds_payload(buf: bytes, audio: Audio) -> bool:
    """Whether the file is one of ``encode``: the length in its tag is that of its frames, which all have its header."""
    told, n = audio.tags.get("payload", ""), len(audio.offsets)
    if not (told.isascii() and told.isdigit()) or not n or audio.header != _FRAME or max(1, -(-int(told) // UNIT)) != n:
        return False
    heads = np.frombuffer(buf, np.uint8)[audio.offsets[:, None] + np.arange(4)]
    return bool((heads == np.frombuffer(_HEAD, np.uint8)).all()) and int(audio.offsets[-1]) + _FRAME.length <= len(buf)


def payload_of(buf: bytes, audio: Audio) -> tuple[bytes, int]:
    """The padded payload of an encoded file, and how many of its units fail their CRC-32."""
    at = audio.offsets[:, None] + np.arange(_AT, _AT + UNIT + 4)
    units = np.frombuffer(buf, np.uint8)[at]
    raw = np.ascontiguousarray(units[:, :UNIT]).tobytes()
    stated = np.ascontiguousarray(units[:, UNIT:]).view(">u4").ravel().tolist()
    return raw, sum(zlib.crc32(raw[k * UNIT : (k + 1) * UNIT]) != c for k, c in enumerate(stated))


def runs_of(offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, step, count) of runs of equally spaced offsets, which give every offset back."""
    out, at = [], 0
    gaps = np.diff(offsets)
    change = np.flatnonzero(np.diff(gaps)) + 1 if len(gaps) else np.zeros(0, np.int64)
    while at < len(offsets):
        step = int(gaps[at]) if at < len(gaps) else 0
        k = np.searchsorted(change, at + 1)
        last = int(change[k]) if k < len(change) else len(offsets) - 1
        out.append((int(offsets[at]), step, last - at + 1))
        at = last + 1
    return out


def feature_of(audio: Audio, payload: bytes) -> str | None:
    """Format, exact duration, seek table and a coarse envelope (mean unit level in eight parts); None without audio."""
    if not audio.header:
        return None
    levels = np.frombuffer(payload, np.uint8).reshape(-1, UNIT).sum(axis=1)
    parts = [int(p.sum() // (UNIT * len(p))) if len(p) else 0 for p in np.array_split(levels, 8)]
    h = audio.header
    seek = zlib.crc32(audio.offsets.astype("<i8").tobytes())
    return f"mpeg{h.version}-layer{h.layer};{'/'.join(map(str, sorted(audio.kbps)))}kbps;{audio.samples}/{h.rate}s;frames={len(audio.offsets)};seek={seek:08x};envelope={bytes(parts).hex()}"


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("step", pa.int32()), ("count", pa.int32())]))


def _run_array(runs: list) -> pa.Array:
    return pa.array([None if r is None else [dict(zip(("first", "step", "count"), x, strict=True)) for x in r] for r in runs], _RUNS)


def _encode_task(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids, texts = batch.columns
        for k, n in byte_parts(texts):
            data = [(t or "").encode() for t in texts.slice(k, n).to_pylist()]
            media = [encode(d) for d in data]
            frames = [max(1, -(-len(d) // UNIT)) for d in data]
            runs = [[(len(m) - 128 - f * _FRAME.length, _FRAME.length if f > 1 else 0, f)] for m, f in zip(media, frames, strict=True)]
            arrays = [ids.slice(k, n), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary()), pa.array([_FRAME.samples * f for f in frames], pa.int64()), pa.array([_FRAME.rate] * n, pa.int32()), _run_array(runs)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media", "n_samples", "sample_rate", "frame_runs"])


MEDIA = "doc_id long, n_bytes long, media binary, n_samples long, sample_rate int, frame_runs array<struct<first: long, step: int, count: int>>"
DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, n_samples long, sample_rate int, bad_checks long, resyncs long, table_frames long, frame_runs array<struct<first: long, step: int, count: int>>"
)


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``, an MPEG audio file that holds the text's UTF-8 bytes, with its exact duration
    (n_samples over sample_rate) and the offsets of its frames (``frame_runs``).

    A null or empty text gives one frame of blanks. Ids may be null or repeat; there is a row for each row. Other
    columns are ignored. Equal texts give equal files. An empty table gives no rows.
    """
    on_workers(docs.sparkSession)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(_encode_task, MEDIA)


def _digest(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 14
    audio = parse(media)
    payload, bad, n_bytes, own = None, 0, None, [None] * 3
    if holds_payload(media, audio):
        payload, bad = payload_of(media, audio)
        n_bytes, own = int(audio.tags["payload"]), [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])]
    rate = audio.header.rate if audio.header else None
    file = [len(media), hashlib.sha256(media).hexdigest(), feature_of(audio, payload or b"")]
    return (n_bytes, *own, *file, len(audio.offsets), audio.samples, rate, bad + audio.bad_checks, audio.resyncs, (audio.vbr or {}).get("frames"), runs_of(audio.offsets))


def _digest_task(batches: Iterator[pa.RecordBatch]):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split(" ")[0] for x in DIGEST.split(", ") if x.split(" ")[0] not in ("step:", "count:")]
    for batch in batches:
        for k, n in byte_parts(batch.column(1)):
            part = batch.slice(k, n)
            columns = list(zip(*(_digest(m) for m in part.column(1).to_pylist()), strict=True))
            arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False)), _run_array(columns[-1])]
            yield pa.RecordBatch.from_arrays(arrays, names)


def media_digest(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parses a table of MPEG audio files, of this module or of others: a row for each row, with the columns of DIGEST.

    ``n_samples`` over ``sample_rate`` is the exact duration; ``frame_runs`` gives the offset of every frame. A file that
    holds no payload of ours has null n_bytes and payload columns; one without any frame (an empty blob, other data) also
    a null feature and sample_rate, and no runs. A null blob has nulls but for its id. Ids may be null or repeat; an empty
    table gives no rows; other columns are ignored.
    """
    on_workers(media.sparkSession)
    chosen = media.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    return chosen.mapInArrow(_digest_task, DIGEST)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the media table to the shared folder and returns it as read back."""
    return settle(to_media(docs, id_col=id_col, text_col=text_col), "media")
