"""MPEG audio media columns: a lossless payload carrier and a resynchronising parser.

``store`` writes bytes as an MPEG-1 Layer III stream (48 kHz, mono, CRC-protected): an ID3v2 tag that
holds the payload's length, a frame with a Xing table (frames, bytes, 100 seek points), frames whose side
information says "no coded spectrum" so that the rest of each frame is ancillary data carrying the
payload, and an ID3v1 tag. The last frame takes the smallest bitrate that fits: variable bitrate.

``parse`` reads any byte string: it reads ID3v2.2 to 2.4 and ID3v1 tags, searches for frame headers wherever sync is
lost, where it accepts a header only if the next frame or the end of the audio follows it, verifies the CRC of protected
frames of Layers I and III, counts those of Layer II as unverified (their CRC spans a bit allocation that is not
decoded), skips free-format frames as lost sync, reads Xing, Info and VBRI tables with the encoder's delay and
padding, and gives an exact duration (samples without those two, over sample rate) and the offset of every frame.

Defined edge cases: null and empty texts store one block of padding; bytes without any frame give zero
frames and no duration; damaged frames are counted, not raised; repeated rows give equal values; only the
columns named are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame

from gossamer.llm.common import utf8

#: Payload unit in bytes; the filler at its end.
UNIT, FILL = 576, b"\xff"

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer) and sample rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x8005 if value & 0x8000 else 0)) & 0xFFFF
        out.append(value)
    return out


_CRC = _crc_table()


@lru_cache(1 << 14)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFF00) ^ _CRC[value >> 8 ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    version: int  # 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of Layer III side information
    alloc: int = 0  # bytes of Layer I bit allocation

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(1 << 14)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, None if they are none. Free-format frames are not taken."""
    (bits,) = struct.unpack(">I", four)
    version, layer, rate, rate_index = bits >> 19 & 3, 4 - (bits >> 17 & 3), bits >> 12 & 15, bits >> 10 & 3
    if bits >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or rate_index == 3:
        return None
    one, mono = version == 3, bits >> 6 & 3 == 3
    kbps, hz, padding = BITRATES[one, layer][rate], RATES[version][rate_index], bits >> 9 & 1
    if layer == 1:
        samples, size = 384, (12000 * kbps // hz + padding) * 4
    else:
        samples = 1152 if one or layer == 2 else 576
        size = samples // 8 * 1000 * kbps // hz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if one else 9 if mono else 17
    joint = bits >> 6 & 3 == 1
    bound = 4 * (1 + (bits >> 4 & 3)) if joint else 32  # bands that each channel has for itself
    alloc = 0 if layer != 1 else 16 if mono else (bound + 32) // 2
    return Header(version, layer, not bits >> 16 & 1, kbps, hz, mono, size, samples, side, alloc)


def _build(kbps: int) -> bytes:
    """Header, CRC and empty side information of a 48 kHz mono frame."""
    bits = 0x7FF << 21 | 3 << 19 | 1 << 17 | BITRATES[True, 3].index(kbps) << 12 | 1 << 10 | 3 << 6
    four, side = struct.pack(">I", bits), bytes(17)
    return four + struct.pack(">H", crc16(four[2:] + side)) + side


_HEADS = {kbps: _build(kbps) for kbps in BITRATES[True, 3][1:]}
_HEAD = 23


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag(payload: int) -> bytes:
    body = b"\x00payload_bytes\x00" + str(payload).encode()
    frame = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    return b"ID3\x03\x00\x00" + _syncsafe(len(frame)) + frame


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + FILL * (max(1, -(-len(data) // unit)) * unit - len(data))


def store(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    top = 320
    room = top * 3 - _HEAD
    whole, rest = divmod(len(payload), room)
    sizes = [top * 3] * whole
    frames = [_HEADS[top] + payload[k * room : (k + 1) * room] for k in range(whole)]
    if rest:
        kbps = next(k for k in BITRATES[True, 3][1:] if k * 3 - _HEAD >= rest)
        frames.append((_HEADS[kbps] + payload[whole * room :]).ljust(kbps * 3, b"\0"))
        sizes.append(kbps * 3)
    first = 64 * 3  # the table's own frame
    total = first + sum(sizes)
    starts = [first + top * 3 * k for k in range(len(sizes))]  # all but the last frame have one size
    toc = bytes(min(255, 256 * (starts[p * len(starts) // 100] if starts else 0) // total) for p in range(100))
    xing = (_HEADS[64] + b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc).ljust(first, b"\0")
    return _tag(len(payload)) + xing + b"".join(frames) + b"TAG".ljust(128, b"\0")


@dataclass
class Audio:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    crc_unverified: int = 0
    delay: int = 0  # samples that the encoder put before and behind the sound
    padding: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a reduced fraction; rates may differ between frames (then nothing is taken off)."""
        top, bottom = 0, 1
        rates = {h.rate for h in self.headers}
        for rate in rates:
            n = sum(h.samples for h in self.headers if h.rate == rate)
            if len(rates) == 1 and n > self.delay + self.padding:
                n -= self.delay + self.padding
            top, bottom = top * rate + n * bottom, bottom * rate
            top, bottom = top // (g := gcd(top, bottom)), bottom // g
        return top, bottom


def _read_tags(data: bytes, out: Audio) -> tuple[int, int]:
    """Where the audio begins and ends; the tags' texts go to ``out``."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end and max(data[start + 6 : start + 10]) < 128:
        size = sum(b << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0)))
        stop = min(end, start + 10 + size)
        _read_frames(data[start + 10 : stop], data[start + 3], data[start + 5], out)
        start = min(end, stop + 10 * (data[start + 5] >> 4 & 1))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        if title := data[end + 3 : end + 33].rstrip(b"\0 "):
            out.tags["id3v1"] = title.decode("latin-1")
    return start, end


def _read_frames(tag: bytes, version: int, flags: int, out: Audio) -> None:
    """Text frames of a tag of version 2.2, 2.3 or 2.4."""
    syncsafe = lambda x: sum(b << s for b, s in zip(x, (21, 14, 7, 0)))
    if flags & 128 and version < 4:
        tag = tag.replace(b"\xff\x00", b"\xff")
    at, head = 0, 6 if version == 2 else 10
    if flags & 64 and version == 3:
        at = 4 + int.from_bytes(tag[:4], "big")
    if flags & 64 and version == 4:
        at = syncsafe(tag[:4])
    while at + head <= len(tag) and tag[at] and version in (2, 3, 4):
        if version == 2:
            name, n = tag[at : at + 3], int.from_bytes(tag[at + 3 : at + 6], "big")
        else:
            name, n = tag[at : at + 4], syncsafe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        body = tag[at + head : at + head + n]
        if version == 4 and tag[at + 9] & 2:
            body = body.replace(b"\xff\x00", b"\xff")
        if name in (b"TXXX", b"TXX") and body[:1] == b"\0":
            key, _, value = body[1:].partition(b"\0")
            out.tags[key.decode("latin-1")] = value.decode("latin-1")
        elif name[:1] == b"T":
            out.tags[name.decode("latin-1")] = body[1:].decode("latin-1").rstrip("\0")
        at += head + n


def parse(data: bytes) -> Audio:
    out = Audio()
    at, end = _read_tags(data, out)
    lost, kind = False, None

    def frame(pos: int) -> Header | None:
        h = header(data[pos : pos + 4]) if pos + 4 <= end else None
        return h if h and pos + h.size <= end else None

    while at < end:
        h = frame(at)
        good = h is not None
        if good and (lost or kind is None):  # in doubt: the next frame has to agree
            after = frame(at + h.size)
            good = at + h.size == end or after is not None and after.kind == h.kind
        if not good:
            out.resyncs += not lost
            lost = True
            step = data.find(b"\xff", at + 1, end)
            out.skipped += (step if step >= 0 else end) - at
            at = step if step >= 0 else end
            continue
        lost = False
        if h.protected:
            body = at + 6
            if h.layer != 2:
                ok = crc16(data[at + 2 : at + 4] + data[body : body + h.side + h.alloc]) == int.from_bytes(data[at + 4 : at + 6], "big")
                out.crc_good += ok
                out.crc_bad += not ok
            else:
                out.crc_unverified += 1
        body = at + 4 + 2 * h.protected + h.side
        if kind is None and h.layer == 3 and _read_table(data, at, body, h, out):
            kind = h.kind
            at += h.size
            continue
        kind = h.kind
        out.offsets.append(at)
        out.headers.append(h)
        at += h.size
    return out


def _read_table(data: bytes, at: int, body: int, h: Header, out: Audio) -> bool:
    if data[body : body + 4] in (b"Xing", b"Info"):
        out.table, pos = data[body : body + 4].decode(), body + 8
        flags = int.from_bytes(data[body + 4 : body + 8], "big")
        if flags & 1:
            out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
        if flags & 2:
            out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
        if flags & 4:
            out.seek, pos = list(data[pos : pos + 100]), pos + 100
        pos += 4 * (flags >> 3 & 1)  # quality
        if data[pos : pos + 4] in (b"LAME", b"Lavf", b"Lavc") and pos + 24 <= at + h.size:
            ends = int.from_bytes(data[pos + 21 : pos + 24], "big")
            out.delay, out.padding = ends >> 12, ends & 0xFFF
        return True
    vbri = at + 36
    if data[vbri : vbri + 4] == b"VBRI" and vbri + 26 <= at + h.size:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, entries, scale, width = struct.unpack(">IIHHH", data[vbri + 10 : vbri + 24])
        pos = vbri + 26
        out.seek = [int.from_bytes(data[pos + k * width : pos + (k + 1) * width], "big") * scale for k in range(entries)]
        return True
    return False


def payload_of(data: bytes, audio: Audio) -> bytes:
    """What ``store`` was given, from the stored bytes."""
    parts = []
    for at, h in zip(audio.offsets, audio.headers):
        parts.append(data[at + 4 + 2 * h.protected + h.side : at + h.size])
    return b"".join(parts)[: int(audio.tags.get("payload_bytes", "0"))]


def with_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as MPEG audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            media = pa.array([store(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), media], names=[doc_id, "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, media binary")


def describe(audio: Audio) -> str:
    kinds = sorted({f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[h.version] } layer{h.layer} {h.rate}Hz {'mono' if h.mono else 'stereo'}" for h in audio.headers})
    rates = sorted({h.kbps for h in audio.headers})
    top, bottom = audio.duration
    return (
        f"{'+'.join(kinds) or 'none'}; frames={len(audio.offsets)}; seconds={top}/{bottom}; kbps={'-'.join(map(str, rates))}; "
        f"table={audio.table or 'none'}:{audio.table_frames}; crc={audio.crc_good}/{audio.crc_good + audio.crc_bad}"
        + (f"; unverified={audio.crc_unverified}" if audio.crc_unverified else "")
        + f"; resyncs={audio.resyncs}"
    )


def media_features(media: DataFrame, column: str = "media", payload: bool = False) -> DataFrame:
    """Parse a media column and append durations, seek offsets, checksums and digests.

    A null media value counts as no bytes. With ``payload`` the bytes that were stored come along.
    """
    from pyspark.sql import types as T

    from gossamer.llm.common import extended

    new = [
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
        T.StructField("n_frames", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("crc_bad", T.LongType()),
        T.StructField("seek_offsets", T.ArrayType(T.LongType())),
    ]
    new += [T.StructField("payload", T.BinaryType())] * payload
    schema = extended(media.schema, new, (column,))
    keep = [f.name for f in schema.fields[: len(schema.fields) - len(new)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(column).to_pylist():
                data = data or b""
                audio = parse(data)
                body = payload_of(data, audio)
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(audio), len(audio.offsets), audio.samples, audio.crc_bad, audio.offsets) + (body,) * payload)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: len(new)]]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + columns, names=[f.name for f in schema.fields])

    return media.mapInArrow(run, schema)
