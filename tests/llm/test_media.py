import hashlib
import zlib

import numpy as np
import pytest

from newstide.llm import media

from . import corpus


def test_round_trip(spark):
    data = corpus.rows()
    got = media.media_features(corpus.frame(spark, data)).collect()
    assert len(got) == len(data)
    want = {}
    for i, t, *_ in data:
        raw = (t or "").encode()
        body = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.setdefault(i, set()).add((len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        assert r.width % 8 == 0 and r.width * r.height >= r.payload_bytes
    assert not media.media_features(corpus.frame(spark, [])).collect()


def bits_of(table, symbol):
    return next((c, n) for s, c, n in media.canonical(*table) if s == symbol)


def scalar_file(blocks, width, height, interval):
    """A JPEG with zero runs and ends of blocks, written bit by bit."""
    dc = ([0, 2, 2, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], list(range(9)))
    ac = ([0, 0, 0, 0, 0, 0, 0, 60, 0, 0, 0, 0, 0, 0, 0, 0], [0x00, 0xF0] + [r << 4 | s for r in range(8) for s in range(1, 8)] + [0x81, 0x91])
    out, bits, past = bytearray(), "", 0

    def magnitude(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            byte = int(bits[k : k + 8], 2)
            out.append(byte)
            if byte == 255:
                out.append(0)
        bits = ""

    for n, block in enumerate(blocks):
        if interval and n and n % interval == 0:
            flush()
            out.extend([0xFF, 0xD0 + (n // interval - 1) % 8])
            past = 0
        s, tail = magnitude(block[0] - past)
        past = block[0]
        c, length = bits_of(dc, s)
        bits += format(c, f"0{length}b") + tail
        run = 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                c, length = bits_of(ac, 0xF0)
                bits += format(c, f"0{length}b")
                run -= 16
            while run > 7:  # the table has no longer runs with values: not used by the blocks below
                raise AssertionError
            s, tail = magnitude(v)
            c, length = bits_of(ac, run << 4 | s)
            bits += format(c, f"0{length}b") + tail
            run = 0
        if run:
            c, length = bits_of(ac, 0)
            bits += format(c, f"0{length}b")
    flush()
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([16] + [1] * 63)) + seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, 1, 1, 0x11, 0]))
    head += seg(0xC4, b"\0" + bytes(dc[0]) + bytes(dc[1])) + seg(0xC4, b"\x10" + bytes(ac[0]) + bytes(ac[1]))
    if interval:
        head += seg(0xDD, bytes([0, interval]))
    return head + seg(0xDA, b"\1\1\0\0\x3f\0") + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_decodes_runs_and_restarts(interval):
    rng = np.random.default_rng(interval)
    blocks = []
    for _ in range(12):
        b = np.zeros(64, int)
        b[0] = rng.integers(-100, 100)
        at = 1
        while at < 60:
            at += int(rng.integers(0, 7))
            if at < 60:
                b[at] = int(rng.choice([-90, -3, 1, 2, 60]))
            at += 1
        if rng.random() < 0.4:
            b[20:] = 0
        if rng.random() < 0.3:
            b[1:] = 0
        blocks.append(b.tolist())
    image = media.parse(scalar_file(blocks, 32, 24, interval))
    found = media.decode([image])[0]
    assert found.tolist() == blocks
    small = media.thumbnail(image, found)
    assert small.shape == (3, 4)
    assert small.ravel().tolist() == [int(np.clip((b[0] * 16 + 4) // 8 + 128, 0, 255)) for b in blocks]
    assert len(media.average_hash(small)) == 16


def test_broken_files():
    good = media.encode(np.zeros(64, np.uint8), np.array([1]), np.array([0]))[0]
    for bad in (b"", b"\xff\xd8", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-12]):
        with pytest.raises(Exception):  # noqa: B017
            media.decode([media.parse(bad)])


def test_any_neighbouring_bytes_round_trip():
    """Every jump between first bytes of blocks has a code, from 0x00 to 0xFF and back."""
    payload = np.zeros((6, 64), np.uint8)
    payload[1::2] = 0xFF
    payload[:, 1:] = np.random.default_rng(0).integers(0, 256, (6, 63))
    (file,) = media.encode(payload.ravel(), np.array([6]), np.array([384]))
    image = media.parse(file)
    assert media.payload_of(image, media.decode([image])[0]) == payload.tobytes()
