"""Media columns in Matroska: EBML elements, clusters, lacing and cues to packet tables.

``mux`` stores a byte payload as one 8-bit PCM track: clusters of laced SimpleBlocks, with
cues. ``packets`` parses any Matroska bytes: variable-length ids and sizes, elements of
unknown size, SimpleBlocks and BlockGroups, Xiph, fixed-size and EBML lacing, and cues; it
yields one row a frame with track, timestamp and byte range. ``media`` and ``packet_table``
apply them to columns, one row at a time inside tasks, without a shuffle.

Defined cases: a null text is an empty one; an empty payload is padded to 64 zero bytes;
a file that is truncated or no Matroska yields the packets that can be read (none, at the
worst); equal payloads give equal files; texts are held in slices of a few MB, and one longer
than that by itself, so a task needs some five times its longest text (2 GB at most).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import slices, text_bytes

#: Element ids of the Matroska specification.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
DEFAULT_DURATION, REFERENCE_BLOCK = 0x23E383, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept free for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + vint(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock body; several frames are put together by EBML lacing."""
    head = vint(track) + struct.pack(">hB", relative, 0x80 | (0x06 if len(frames) > 1 else 0))
    if len(frames) == 1:
        return head + frames[0]
    sizes = [len(f) for f in frames]
    lace = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
        lace += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + bytes([len(frames) - 1]) + lace + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` as the samples of one mono 8-bit PCM track of 8 kHz."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    body = [element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000))]
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    body.append(element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio))))
    at, cues, block, cluster = sum(map(len, body)), [], FRAME * LACED, FRAME * LACED * BLOCKS
    for start in range(0, len(payload), cluster):
        time = start * 1000 // RATE
        parts = [_uint(TIMESTAMP, time)]
        for b in range(start, min(start + cluster, len(payload)), block):
            frames = [payload[f : min(f + FRAME, len(payload))] for f in range(b, min(b + block, len(payload)), FRAME)]
            parts.append(element(SIMPLE_BLOCK, _laced(1, b * 1000 // RATE - time, frames)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _vint(data, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place behind it; -1 for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > end:
        raise IndexError
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of every element, depth first; those cut off by the file's end are left out,
    but for the masters, whose readable children follow."""
    stack = [len(data) if end is None else end]
    while True:
        while stack and at >= stack[-1]:
            stack.pop()
        if not stack:
            return
        try:
            kind, body = _vint(data, at, stack[-1], keep=True)
            size, body = _vint(data, body, stack[-1])
        except IndexError:
            at = stack[-1]
            continue
        stop = stack[-1] if size < 0 else body + size
        if kind in _MASTERS:
            stop = min(stop, stack[-1])
            yield kind, body, stop
            stack.append(stop)
            at = body
        else:
            if stop <= stack[-1]:
                yield kind, body, stop
            at = stop


def _frames(data, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and byte ranges of a block's frames."""
    track, at = _vint(data, at, end)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                size += data[at]
                at += 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif lacing == 3:
        for i in range(n - 1):
            before = at
            x, at = _vint(data, at, end)
            sizes.append(x if not i else sizes[-1] + x - ((1 << (7 * (at - before) - 1)) - 1))
    else:
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end:
        raise IndexError
    return track, relative, flags, [*out, (at, end)]


def packets(data) -> list[tuple[int, int, int, int, bool]]:
    """(track, timestamp, start, end, keyframe) of every frame in file order.

    Timestamps are milliseconds: a block's ticks times the file's scale; the frames of a lace
    follow each other by the track's default duration, where its entry has one, in whatever order. A frame of a block
    group is a keyframe unless the group refers to another block.
    """
    base, scale, group = 0, 1_000_000, 0
    entry: dict[int, int] = {}
    duration: dict[int, int] = {}
    out: list[tuple[int, int, int, int, bool]] = []
    for kind, at, end in elements(data):
        if kind == TIMESTAMP:
            base = int.from_bytes(data[at:end], "big")
        elif kind == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif kind == TRACK_ENTRY:
            entry = {}
        elif kind in (TRACK_NUMBER, DEFAULT_DURATION):
            entry[kind] = int.from_bytes(data[at:end], "big")
            if len(entry) == 2:
                duration[entry[TRACK_NUMBER]] = entry[DEFAULT_DURATION]
        elif kind == BLOCK_GROUP:
            group = len(out)
        elif kind == REFERENCE_BLOCK:
            out[group:] = [(*p[:4], False) for p in out[group:]]
        elif kind in (SIMPLE_BLOCK, BLOCK):
            try:
                track, relative, flags, ranges = _frames(data, at, end)
            except (IndexError, struct.error):
                continue
            first, step = (base + relative) * scale, duration.get(track, 0)
            out += [(track, (first + i * step) // 1_000_000, a, b, kind == BLOCK or bool(flags & 0x80)) for i, (a, b) in enumerate(ranges)]
    return out


def cue_points(data) -> list[tuple[int, int]]:
    """(timestamp, cluster position within the segment)."""
    out, time = [], 0
    for kind, at, end in elements(data):
        if kind == CUE_TIME:
            time = int.from_bytes(data[at:end], "big")
        elif kind == CUE_CLUSTER_POSITION:
            out.append((time, int.from_bytes(data[at:end], "big")))
    return out


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text, padded with zero bytes to a positive multiple of 64, as a Matroska file."""

    def run(batches):
        for part in (p for whole in batches for p in slices(whole, 1)):
            raw = text_bytes(part.column(1))
            files = [mux(t + b"\0" * (-len(t) % 64 if t else 64)) for t in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a packet of the ``media`` column: key, seq, track, timestamp, start, length, keyframe."""

    def run(batches):
        for batch in (p for whole in batches for p in slices(whole, 1)):
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = packets(data or b"")
                if rows:
                    track, time, start, end, keyframe = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(track, pa.int32()), pa.array(time, pa.int64()), pa.array(start, pa.int64()), pa.array([b - a for a, b in zip(start, end, strict=True)], pa.int64()), pa.array(keyframe)], names=[key, "seq", "track", "timestamp", "start", "length", "keyframe"])

    return files.select(F.col(key).cast("long"), "media").mapInArrow(run, f"{key} long, seq int, track int, timestamp long, start long, length long, keyframe boolean")


def read_back(files: DataFrame) -> DataFrame:
    """Digests of stored media: the payload put together from its packets, the file, and a feature line."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in (p for whole in batches for p in slices(whole, 2)):
            out = []
            for i, n, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = packets(data)
                payload = b"".join([data[a:b] for _, _, a, b, _ in rows])
                tracks = {r[0] for r in rows}
                quiet = payload.count(b"\0") / max(len(payload), 1)
                feature = f"tracks={len(tracks)};packets={len(rows)};last_ms={rows[-1][1] if rows else 0};cues={len(cue_points(data))};mean={sum(payload) / max(len(payload), 1):.4f};zero={quiet:.4f}"
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            names = [x.split()[0] for x in fields.split(", ")]
            kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in fields.split(", ")]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, fields)
