import pytest

from gossamer.llm import mpeg as M


def test_protected_frames_of_layer_two_count_as_unverified(layer=2):
    four = (0x7FF << 21 | 3 << 19 | (4 - layer) << 17 | 8 << 12 | 1 << 10).to_bytes(4, "big")
    media = four.ljust(M.header(four).size, b"\0") * 3
    audio = M.parse(media)
    assert len(audio.offsets) == audio.crc_unverified == 3 and audio.crc_good == audio.crc_bad == 0
    assert "crc=0/0; unverified=3;" in M.describe(audio)
    assert "unverified" not in M.describe(M.parse(M.store(b"x")))


@pytest.mark.parametrize("mode, alloc", [(0, 32), (3, 16), (1 | 0 << 2, 18), (1 | 2 << 2, 22)])
def test_layer_one_checksums(mode, alloc):
    """Header and bit allocation: 4 bits a band and channel, bands above the bound once in joint stereo."""
    four = (0x7FF << 21 | 3 << 19 | 3 << 17 | 8 << 12 | 1 << 10 | (mode & 3) << 6 | (mode >> 2) << 4).to_bytes(4, "big")
    bits = bytes(range(7, 7 + alloc))
    frame = (four + M.crc16(four[2:] + bits).to_bytes(2, "big") + bits).ljust(M.header(four).size, b"\x11")
    assert M.header(four).alloc == alloc
    bad = bytearray(frame)
    bad[6 + alloc - 1] ^= 1
    after = bytearray(frame)
    after[6 + alloc] ^= 1  # behind the allocation: not covered
    audio = M.parse(frame + bytes(bad) + bytes(after))
    assert (audio.crc_good, audio.crc_bad, audio.crc_unverified) == (2, 1, 0)


def syncsafe(n):
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


@pytest.mark.parametrize("version, flags, frames", [
    (2, 0, b"TT2\0\0\6\0Title" + b"TXX\0\0\5\0k\0vv"),
    (3, 0, b"TIT2\0\0\0\6\0\0\0Title" + b"TXXX\0\0\0\5\0\0\0k\0vv"),
    (3, 64, b"\0\0\0\6\0\0\0\0\0\0" + b"TIT2\0\0\0\6\0\0\0Title" + b"TXXX\0\0\0\5\0\0\0k\0vv"),
    (3, 128, b"TIT2\0\0\0\7\0\0\0Title\xff\0" + b"TXXX\0\0\0\5\0\0\0k\0vv"),
    (4, 64, b"\0\0\0\6\1\0" + b"TIT2\0\0\0\6\0\0\0Title" + b"TXXX\0\0\0\5\0\0\0k\0vv"),
])
def test_tags_of_other_versions(version, flags, frames):
    media = M.store(M.padded(b"x"))
    own = media[: 10 + int.from_bytes(media[6:10], "big")]
    tag = b"ID3" + bytes([version, 0, flags]) + syncsafe(len(frames)) + frames
    audio = M.parse(tag + media)
    assert audio.tags["k"] == "vv" and audio.tags["TT2" if version == 2 else "TIT2"].startswith("Title")
    assert M.payload_of(tag + media, audio) == M.padded(b"x") and audio.resyncs == 0 and own


def test_encoder_delay_is_not_sound():
    media = bytearray(M.store(M.padded(b"q" * 5000)))
    whole = M.parse(bytes(media))
    at = media.index(b"Xing") + 8 + 4 + 4 + 100
    media[at : at + 9] = b"LAME3.100"
    media[at + 21 : at + 24] = (576 << 12 | 1000).to_bytes(3, "big")
    got = M.parse(bytes(media))
    assert (got.delay, got.padding) == (576, 1000) and got.samples == whole.samples
    assert got.duration[0] * 48000 == (whole.samples - 1576) * got.duration[1]
