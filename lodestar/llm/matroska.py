"""Media columns: Matroska containers to and from bytes, and their packet tables.

The reader walks EBML elements of any length (known or unknown sizes, identifiers of 1 to 4
bytes), clusters, simple blocks and block groups, all four kinds of lacing, and cues. Every frame
becomes a packet: track, timestamp, and the byte range at which it lies in the file.

Cases: a null text is stored as an empty one; an empty text is one padded frame; a file that is
cut short or malformed raises MatroskaError in the reader, and packet_table() gives it one row
with the error and no packet; null media give no rows; equal texts give equal bytes, as nothing
in a file depends on time or chance.
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

from lodestar.llm.common import map_arrow

# Identifiers of the elements in use.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383
CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
# Flag bits of a block.
LACINGS = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}
KEYFRAME = 0x80
UNKNOWN = -1

FRAME = 192  # samples of a frame
RATE = 8000  # samples a second: a frame lasts 24 ms
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 100  # 19.2 s, within the 16 bits of a block's relative time


class MatroskaError(ValueError):
    """The bytes are not a well-formed file."""


# --- writing ---


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:  # all ones means unknown
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return element(ident, struct.pack(">d", x))


def _signed_size(n: int) -> bytes:
    width = 1
    while not -(1 << (7 * width - 1)) < n < (1 << (7 * width - 1)):
        width += 1
    return _size_fixed(n + (1 << (7 * width - 1)) - 1, width)


def _size_fixed(n: int, width: int) -> bytes:
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def block(track: int, relative: int, frames: list[bytes], lacing: str = "fixed", flags: int = KEYFRAME) -> bytes:
    """Body of a (simple) block. One frame is never laced; unequal frames cannot be laced as fixed."""
    kind = "none" if len(frames) == 1 else lacing
    head = _size(track) + struct.pack(">hB", relative, flags | LACINGS[kind] << 1)
    if kind == "none":
        if len(frames) != 1:
            raise MatroskaError("several frames need lacing")
        return head + frames[0]
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    elif len({*sizes}) > 1:
        raise MatroskaError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def mux(payload: bytes, lacing: str = "fixed", frame: int = FRAME) -> bytes:
    """8-bit samples as a Matroska file with one track; len(payload) is a multiple of frame."""
    ms = frame * 1000 // RATE
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    n = len(payload) // frame
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, float(n * ms)) + element(0x4D80, b"lodestar") + element(0x5741, b"lodestar"))
    audio = element(AUDIO, _float(SAMPLING, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues, step = sum(map(len, parts)), [], FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, n, step):
        body = [_uint(TIMESTAMP, first * ms)]
        for k in range(first, min(n, first + step), FRAMES_A_BLOCK):
            frames = [payload[i * frame : (i + 1) * frame] for i in range(k, min(n, k + FRAMES_A_BLOCK, first + step))]
            body.append(element(SIMPLE_BLOCK, block(1, (k - first) * ms, frames, lacing)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# --- reading ---


def _vint(data: bytes, at: int, end: int, keep: bool, most: int) -> tuple[int, int]:
    """(value, next place). keep: with the length marker, as identifiers are written."""
    if at >= end:
        raise MatroskaError(f"cut short at byte {at}")
    first = data[at]
    width = 9 - first.bit_length() if first else most + 1
    if width > most or at + width > end:
        raise MatroskaError(f"bad length at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (UNKNOWN if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, level_ends: frozenset = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start, start of body, end of body) of the elements in data[at:end]. An element
    of unknown size ends at the next element that belongs above it (level_ends), or at end."""
    while at < end:
        start = at
        ident, at = _vint(data, at, end, True, 4)
        size, body = _vint(data, at, end, False, 8)
        if size == UNKNOWN:
            if ident == SEGMENT:
                stop = end
            elif ident == CLUSTER:
                stop = _unknown_end(data, body, end)
            else:
                raise MatroskaError(f"element {ident:x} at byte {start} has no size")
        else:
            stop = body + size
            if stop > end:
                raise MatroskaError(f"element {ident:x} at byte {start} ends beyond its parent")
        yield ident, start, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    """A cluster of unknown size ends where an element of the segment's level begins."""
    while at < end:
        ident, body = _vint(data, at, end, True, 4)
        if ident in (CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770):
            return at
        size, body = _vint(data, body, end, False, 8)
        at = body + size
    return end


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block whose frames begin with the lace header at ``at``."""
    if kind == LACINGS["none"]:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError(f"no lace header at byte {at}")
    n, at = data[at] + 1, at + 1
    if kind == LACINGS["fixed"]:
        if (end - at) % n:
            raise MatroskaError(f"fixed lace at byte {at} does not divide")
        size = (end - at) // n
        return [(at + k * size, size) for k in range(n)]
    sizes: list[int] = []
    if kind == LACINGS["xiph"]:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("lace sizes are cut short")
                step, at = data[at], at + 1
                size += step
                if step < 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at = _vint(data, at, end, False, 8)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            delta, at = _vint(data, at, end, False, 8)
            width = at - before
            delta = (1 << 7 * width) - 1 if delta == UNKNOWN else delta
            size += delta - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    if min(sizes, default=0) < 0 or at + sum(sizes) > end:
        raise MatroskaError(f"lace at byte {at} is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return [*out, (at, end - at)]


@dataclass
class Movie:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time ns, track, byte of the cluster
    clusters: list[tuple[int, int, int]] = field(default_factory=list)  # time ns, start, end
    packets: list[tuple[int, int, int, int, int, bool, int]] = field(default_factory=list)
    # track, time ns, start, length, lacing, keyframe, cluster


def demux(data: bytes) -> Movie:
    """Parse a file. Timestamps of laced frames advance by the track's default duration, or by an
    equal part of the block's duration where the file gives one."""
    out, root = Movie(), elements(data, 0, len(data))
    ident, _, a, b = next(root, (0, 0, 0, 0))
    if ident != EBML or not any(i == DOC_TYPE and data[x:y] in (b"matroska", b"webm") for i, _, x, y in elements(data, a, b)):
        raise MatroskaError("no Matroska header")
    for ident, _, base, stop in root:
        if ident != SEGMENT:
            continue
        for ident, start, a, b in elements(data, base, stop):
            if ident == INFO:
                for i, _, x, y in elements(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        out.scale = _number(data, x, y)
                    elif i == DURATION:
                        out.duration = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
            elif ident == TRACKS:
                for i, _, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        got = {j: (u, v) for j, _, u, v in elements(data, x, y)}
                        value = lambda j, d: _number(data, *got[j]) if j in got else d  # noqa: E731, B023
                        codec = data[slice(*got.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")
                        out.tracks[value(TRACK_NUMBER, 0)] = {"codec": codec, "type": value(TRACK_TYPE, 0), "default": value(DEFAULT_DURATION, 0)}
            elif ident == CLUSTER:
                _cluster(data, a, b, out, start)
            elif ident == CUES:
                for i, _, x, y in elements(data, a, b):
                    if i == CUE_POINT:
                        point = [*elements(data, x, y)]
                        when = next((_number(data, u, v) for j, _, u, v in point if j == CUE_TIME), 0)
                        for j, _, u, v in point:
                            if j == CUE_POSITIONS:
                                got = {k: _number(data, p, q) for k, _, p, q in elements(data, u, v)}
                                out.cues.append((when * out.scale, got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))
    return out


def _cluster(data: bytes, a: int, b: int, out: Movie, start: int) -> None:
    when, number = 0, len(out.clusters)
    for ident, _, x, y in elements(data, a, b):
        if ident == TIMESTAMP:
            when = _number(data, x, y)
        elif ident == SIMPLE_BLOCK:
            _block(data, x, y, when, out, number, None, None)
        elif ident == BLOCK_GROUP:
            got = {j: (u, v) for j, _, u, v in elements(data, x, y)}
            if BLOCK in got:
                lasts = _number(data, *got[BLOCK_DURATION]) if BLOCK_DURATION in got else None
                _block(data, *got[BLOCK], when, out, number, lasts, 0xFB not in got)  # no reference: a key frame
    out.clusters.append((when * out.scale, start, b))


def _block(data: bytes, a: int, b: int, when: int, out: Movie, number: int, lasts: int | None, key: bool | None) -> None:
    track, at = _vint(data, a, b, False, 8)
    if at + 3 > b:
        raise MatroskaError(f"block at byte {a} is cut short")
    relative, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    frames = laces(data, at + 3, b, kind)
    step = lasts * out.scale // len(frames) if lasts is not None else out.tracks.get(track, {}).get("default", 0)
    time, key = (when + relative) * out.scale, bool(flags & KEYFRAME) if key is None else key
    out.packets += [(track, time + k * step, s, n, kind, key, number) for k, (s, n) in enumerate(frames)]


def read_payload(data: bytes, movie: Movie, track: int = 1) -> bytes:
    return b"".join([data[s : s + n] for t, _, s, n, *_ in movie.packets if t == track])


# --- columns ---


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with spaces appended up to a positive multiple of FRAME; and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)), len(raw)


def feature_of(movie: Movie, payload: bytes) -> str:
    """Packets, clusters, cues, length in ms and the samples' mean, deviation and sign changes
    around the middle of their range, in whole thousandths."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int(np.bincount(x, minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    up = x >= 100
    crossings = int((up[1:] != up[:-1]).sum())
    return f"packets={len(movie.packets)};clusters={len(movie.clusters)};cues={len(movie.cues)};ms={int(movie.duration)};mean={total * 1000 // n};variance={(square * n - total * total) * 1000 // (n * n)};crossings={crossings}"


MEDIA = "doc_id long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PACKETS = "doc_id long, track int, timestamp_ns long, start long, length long, lacing int, keyframe boolean, cluster int, error string"


def _batches(batches: Iterator[pa.RecordBatch], row, schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """row(doc_id, value) gives rows; they leave in batches, so memory does not grow with the part."""
    held: list[tuple] = []
    weight = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        ids, values = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            for got in row(ids[k].as_py(), values[k].as_py()):
                held.append(got)
                weight += 100 + sum(len(v) for v in got if isinstance(v, (bytes, str)))
                if weight >= most:
                    yield make()
                    held, weight = [], 0
    if held:
        yield make()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def store(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """(doc_id, text) -> (doc_id, media): each text as the samples of a Matroska file."""
    return map_arrow(docs.select("doc_id", "text"), lambda it: _batches(it, lambda i, t: [(i, mux(payload_of(t)[0], lacing))], _arrow(MEDIA)), MEDIA)


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> a row for each packet; a malformed file gives one row with its error."""

    def rows(i, data):
        if data is None:
            return
        try:
            movie = demux(data)
        except MatroskaError as e:
            yield (i, None, None, None, None, None, None, None, str(e))
            return
        for p in movie.packets:
            yield (i, *p, None)

    return map_arrow(media.select("doc_id", "media"), lambda it: _batches(it, rows, _arrow(PACKETS)), PACKETS)


def _digest(i, text):
    payload, n = payload_of(text)
    media = mux(payload)
    movie = demux(media)
    back = read_payload(media, movie)
    yield (i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(movie, back))


def digest(docs: DataFrame) -> DataFrame:
    """Store each text, read the file back and describe both; the file itself stays in the task."""
    return map_arrow(docs.select("doc_id", "text"), lambda it: _batches(it, _digest, _arrow(DIGEST)), DIGEST)
