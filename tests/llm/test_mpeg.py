import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import mpeg as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    payload = M.padded(data)
    media = M.store(payload)
    audio = M.parse(media)
    assert M.payload_of(media, audio) == payload
    assert audio.crc_bad == audio.resyncs == 0
    assert audio.table == "Xing" and audio.table_frames == len(audio.offsets)
    assert audio.duration[0] * 48000 == audio.samples * audio.duration[1] and audio.samples == 1152 * len(audio.offsets)


@pytest.mark.parametrize("data", [b"\xff" * 4000, b"\xff\xfb\x90\x00" * 900])
def test_payload_that_looks_like_frames(data):
    media = M.store(M.padded(data))
    assert M.payload_of(media, M.parse(media)) == M.padded(data)


def test_padding():
    assert [len(M.padded(b"x" * n)) for n in (0, 1, 576, 577)] == [576, 576, 576, 1152]


def test_resynchronises_and_verifies():
    media = bytearray(M.store(M.padded(b"q" * 6000)))
    clean = M.parse(bytes(media))
    broken = bytes(media[: clean.offsets[2]]) + b"\x00\xff\xe0garbage" + bytes(media[clean.offsets[2] :])
    got = M.parse(broken)
    assert (len(got.offsets), got.resyncs) == (len(clean.offsets), 1) and got.skipped == 10
    media[clean.offsets[3] + 10] ^= 1  # side information
    assert M.parse(bytes(media)).crc_bad == 1
    assert M.parse(b"").offsets == [] and M.parse(b"\xff" * 50).duration == (0, 1)


def test_headers_of_other_kinds():
    h = M.header(bytes.fromhex("fffb9064"))
    assert (h.kbps, h.rate, h.size, h.samples, h.mono, h.side) == (128, 44100, 417, 1152, False, 32)
    h = M.header(bytes.fromhex("fff344c4"))
    assert (h.version, h.layer, h.rate, h.samples, h.side) == (2, 3, 24000, 576, 9)
    assert M.header(b"\xff\xff\xff\xff") is None and M.header(b"\x00\x00\x00\x00") is None


def test_query_columns(docs):
    texts = [None, "", "é" * 700, "x" * 200_000, "", "\xff"]
    rows = M.media_features(M.with_media(docs(texts))).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        raw = (t or "").encode()
        p = M.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.n_samples == r.n_frames * 1152 and len(r.seek_offsets) == r.n_frames and "media" not in r.asDict()
    assert rows[0][1:] == rows[1][1:] == rows[4][1:]
    assert M.media_features(M.with_media(docs([]))).count() == 0
