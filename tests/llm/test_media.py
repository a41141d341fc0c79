import hashlib
import io
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from srcatlas.llm import media


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 9))
def test_round_trips(height, width, seed):
    samples = np.random.default_rng(seed).integers(0, 256, (height, width), np.uint8)
    assert (media.decode(media.encode_pgm(samples)) == samples).all()
    assert (media.decode(media.encode_bmp(samples)) == samples).all()


def test_other_formats():
    assert media.decode(b"P2 # c\n2 1 255\n7 9").tolist() == [[7, 9]]
    assert media.decode(b"P1\n2 2\n1 0\n0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0])).tolist() == [[0] + [255] * 8]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6\n1 1\n255\n" + bytes([4, 5, 6])).tolist() == [[[4, 5, 6]]]
    assert media.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    head = struct.pack("<2sIHHI", b"BM", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, -2, 1, 24, 0, 8, 0, 0, 0, 0)
    assert media.decode(head + bytes([1, 2, 3, 0, 4, 5, 6, 0])).tolist() == [[[3, 2, 1]], [[6, 5, 4]]]
    for bad in (b"", b"GIF8", b"P5\n2 2\n255\n1", b"P5\nx"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 12), st.integers(1, 12))
def test_area_resize_is_the_mean_over_exact_areas(rows, columns, height, width):
    samples = np.random.default_rng(rows * 31 + columns).integers(0, 256, (rows, columns)).astype(np.uint8)
    fine = np.repeat(np.repeat(samples, height, 0), width, 1).astype(float)
    expected = fine.reshape(height, rows, width, columns).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(samples, height, width), expected)


def test_facts_are_of_what_was_read_back(docs):
    texts = {1: "héllo", 2: "", 3: None, 4: "x" * 64, 5: "long " * 50_000}
    out = {r["doc_id"]: r for r in media.text_media(docs([*texts.items(), (6, "héllo")])).collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert out[i]["n_bytes"] == len(raw) and out[i]["payload_bytes"] == len(payload)
        assert out[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert out[i]["tail_crc32"] == zlib.crc32(payload[-64:])
    same = ("payload_sha256", "media_sha256", "feature", "media_bytes")
    assert all(out[1][k] == out[6][k] for k in same) and all(out[2][k] == out[3][k] for k in same)
    tile = np.load(io.BytesIO(out[5]["tile_npy"]))
    assert tile.shape == (32, 32) and tile.dtype == np.uint8
    assert media.text_media(docs([])).count() == 0


def test_a_tall_image_is_resized_in_parts(monkeypatch):
    samples = np.random.default_rng(5).integers(0, 256, (1000, 64)).astype(np.uint8)
    whole = [media.area_resize(samples, h, w) for h, w in ((8, 9), (32, 32), (999, 3))]
    monkeypatch.setattr(media, "ROWS", 7)
    parts = [media.area_resize(samples, h, w) for h, w in ((8, 9), (32, 32), (999, 3))]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_a_very_long_text_needs_little_more_than_its_copies():
    text = b"0123456789abcdef" * (1 << 21)  # 32 MB
    tracemalloc.start()
    facts = media.media_of(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert facts[2] == hashlib.sha256(text).hexdigest()
    assert peak < 4 * len(text)
