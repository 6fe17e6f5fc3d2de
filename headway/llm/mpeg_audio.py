"""Media columns: MPEG audio streams in a binary column.

`encode` puts a payload into Layer III frames, one unit of 576 bytes a frame, behind an ID3v2 tag and a frame with a
variable-bitrate table, and closes with an ID3v1 tag. `parse` reads any MPEG audio stream: it skips tags, searches for
frame headers again after damage, checks the frames' CRC-16, reads Xing/Info and VBRI tables, and returns exact
durations and the frames' offsets. Both work on one value at a time; Spark deals the rows.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from headway.llm.common import pieces

#: Bytes of payload in a frame.
UNIT = 576
#: Fixed values of the format: kbit/s by (MPEG version 1 or not, layer), and sampling rates by the version's two bits.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: MPEG 1, Layer III, protected, 224 kbit/s, 48 kHz, mono: 672 bytes and 1152 samples a frame.
HEADER = bytes((0xFF, 0xFA, 0xC4, 0xC0))
SIDE = 17
FRAME = 672
MEDIA_SCHEMA = "media binary"


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's CRC: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """A frame header's four bytes, or None where they aren't one. Free-format frames aren't read."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, kbps, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or kbps in (0, 15) or rate == 3:
        return None
    first, mono = version == 3, raw[3] >> 6 == 3
    kbps, rate, pad = KBPS[first, layer][kbps], RATES[version][rate], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    side = 0 if layer < 3 else ((17 if mono else 32) if first else (9 if mono else 17))
    return Header(version, layer, not raw[1] & 1, kbps, rate, mono, size, samples, side)


def units(data: bytes) -> bytes:
    """The data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """A stream that holds the payload, whose length must be a multiple of UNIT."""
    if len(payload) % UNIT:
        raise ValueError("the payload must be whole units")
    n = len(payload) // UNIT
    side = bytes(SIDE)
    start = HEADER + crc16(HEADER[2:] + side).to_bytes(2, "big") + side
    text = b"\x03" + f"{n} units of {UNIT} bytes".encode()
    tag = b"TIT2" + struct.pack(">IH", len(text), 0) + text
    tag = b"ID3\x03\x00\x00" + syncsafe(len(tag)) + tag
    toc = bytes(256 * (1 + k * n // 100) // (n + 1) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, FRAME * (n + 1)) + toc
    fill = bytes(FRAME - len(start) - UNIT)
    frames = [(start + table).ljust(FRAME, b"\0")]
    for i in range(0, len(payload), UNIT):
        frames += (start, payload[i : i + UNIT], fill)
    return b"".join((tag, *frames, b"TAG".ljust(128, b"\0")))


@dataclass
class Stream:
    """What `parse` finds. offsets: of the audio frames; bad_crc: frames whose checksum differs; skipped: bytes outside frames and tags."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbps: set[int] = field(default_factory=set)
    bad_crc: int = 0
    resyncs: int = 0
    skipped: int = 0
    data: list[bytes] = field(default_factory=list)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as an exact fraction."""
        k = math.gcd(self.samples, self.rate) or 1
        return self.samples // k, self.rate // k


def _id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """End of the tag at `at`, and its text frames."""
    n = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
    end, p, tags = at + 10 + n + 10 * bool(data[at + 5] & 16), at + 10, {}
    while p + 10 <= min(end, len(data)) and data[p : p + 4].isalnum():
        size = int.from_bytes(data[p + 4 : p + 8], "big") if data[at + 3] < 4 else sum((b & 127) << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0)))
        body = data[p + 10 : p + 10 + size]
        if data[p : p + 1] == b"T" and body:
            tags[data[p : p + 4].decode("latin-1")] = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
        p += 10 + size
    return end, tags


def _vbr(frame: bytes, h: Header) -> tuple[dict[str, int], bytes] | None:
    """A Xing, Info or VBRI table in a frame's data, or None."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p, out, toc = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}, b""
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            toc = frame[p : p + 100]
        return out, toc
    if frame[36:40] == b"VBRI":
        size, frames = struct.unpack(">II", frame[46:54])
        return {"frames": frames, "bytes": size}, b""
    return None


def parse(data: bytes) -> Stream:
    """Reads a stream. A header counts if it has the kind of the frame before, or is followed by another header, a tag or the end; else the search goes on byte by byte."""
    out, at, lost, first, kind = Stream(), 0, False, True, None
    end = len(data)
    if data[max(0, end - 128) :][:3] == b"TAG" and end >= 128:
        end -= 128
        if title := data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"):
            out.tags["title"] = title
    while at < end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at, tags = _id3v2(data, at)
            out.tags |= tags
            continue
        h = header(data[at : at + 4])
        if h and at + h.size <= end and ((not lost and kind == (h.version, h.layer, h.rate)) or at + h.size == end or header(data[at + h.size : at + h.size + 4]) or data[at + h.size : at + h.size + 3] == b"ID3"):
            frame = data[at : at + h.size]
            lost, kind = False, (h.version, h.layer, h.rate)
            if h.protected and h.layer == 3 and crc16(frame[2:4] + frame[6 : 6 + h.side]) != int.from_bytes(frame[4:6], "big"):
                out.bad_crc += 1
            if first and (table := _vbr(frame, h)):
                out.table, out.toc = table
            else:
                out.offsets.append(at)
                out.samples += h.samples
                out.kbps.add(h.kbps)
                out.rate = out.rate or h.rate
                out.data.append(frame[4 + 2 * h.protected + h.side :])
            first = False
            at += h.size
            continue
        if not lost:
            lost, out.resyncs = True, out.resyncs + 1
        out.skipped += 1
        at += 1
        if (to := data.find(b"\xff", at, end)) != at:
            to = end if to < 0 else to
            out.skipped += to - at
            at = to
    return out


def decode(stream: Stream) -> bytes:
    """The payload that `encode` was given."""
    return b"".join(x[:UNIT] for x in stream.data)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows plus n_bytes and media, the stream that holds the text's UTF-8 bytes as units. Null text: no bytes, one unit.

    Equal texts give equal streams, in rows that repeat too. An empty table gives no rows. A column of the rows with one of
    these names is replaced.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "media")]
    out = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                raw = [b"" if x is None else x.encode() for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(units(x)) for x in raw], pa.binary())], [*part.schema.names, "n_bytes", "media"])

    return out.mapInArrow(run, f"{schema}, n_bytes long, media binary")


#: What `features` adds to the rows it is given. seconds: exact, as numerator and denominator.
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, samples long, rate int, seconds array<long>, offsets array<int>, table_frames int, table_bytes long, bad_crc int, resyncs int, skipped long, title string"


def features(media: DataFrame, keep: list[str]) -> DataFrame:
    """Reads the column media back: the columns in `keep`, and FEATURES. Null media: nulls; damaged media: what can be read."""
    sub = media.select(*keep, "media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sub.select(*keep).schema.fields)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(kinds)
        s = parse(raw)
        payload = decode(s)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), len(s.offsets), s.samples, s.rate, list(s.duration), s.offsets, s.table.get("frames"), s.table.get("bytes"), s.bad_crc, s.resyncs, s.skipped, s.tags.get("TIT2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media"):
                cols = zip(*map(one, part.column("media").to_pylist())) if part.num_rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(list(x), k) for x, k in zip(cols, kinds))], [*keep, *names])

    return sub.mapInArrow(run, f"{schema}, {FEATURES}")
