"""Fingerprints, difference maps and metadata, on generated pictures and bytes."""

import struct

import numpy as np
import pytest

from kinsight.functions import images, metadata


def blocks(seed, side=64, cell=8):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (side // cell, side // cell)), np.ones((cell, cell), int))


def test_fingerprint_invariants():
    a, b = images._fingerprint(blocks(1), 4000, 3000), images._fingerprint(blocks(2), 4000, 3000)
    assert a == images._fingerprint(blocks(1), 4000, 3000)
    assert a["pixel_hash"] != b["pixel_hash"]
    turned = images._fingerprint(np.rot90(blocks(1)), 3000, 4000)
    assert turned["phash"] == a["phash"]
    assert (a["phash"] ^ b["phash"]).bit_count() > 8
    assert images._fingerprint(np.full((64, 64), 200), 1000, 1000)["contrast"] < 1


def test_area_means_by_brute_force():
    square = np.random.default_rng(3).integers(0, 256, (64, 64))
    got = images._cells(square, 9, 8)
    for y in range(8):
        for x in range(9):
            part = square[y * 64 // 8 : (y + 1) * 64 // 8, x * 64 // 9 : (x + 1) * 64 // 9]
            assert got[y, x] == part.sum() // part.size


def test_difference_kinds():
    rng = np.random.default_rng(5)
    a = np.kron(rng.integers(40, 200, (18, 24)), np.ones((8, 8), int))
    assert images.difference(a, a)["kind"] == "Identical"
    noisy = np.clip(a + rng.integers(-4, 5, a.shape), 0, 255)
    assert not images.difference(a, noisy)["separate"]
    moved = a.copy()
    moved[40:75, 60:95] = 255 - moved[40:75, 60:95]
    got = images.difference(a, moved)
    assert got["concentration"] > 0.5 and got["separate"]
    bright = np.clip(a + 30, 0, 255)
    assert images.difference(a, bright)["kind"] == "Identical"
    assert images.difference(a, 255 - rng.integers(0, 256, a.shape))["kind"] == "Different"


def tiff(entries, order="<"):
    """A TIFF block of (tag, type, count, value bytes or number)."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    body, extra, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        if isinstance(value, bytes) and len(value) > 4:
            body += struct.pack(order + "HHII", tag, kind, count, at + len(extra))
            extra += value
        elif isinstance(value, bytes):
            body += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            body += struct.pack(order + "HHII", tag, kind, count, value)
    return head + struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", 0) + extra


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(exif=None, table=None, scan=b"image"):
    parts = [b"\xff\xd8", segment(0xE0, b"JFIF\0")]
    if exif is not None:
        parts.append(segment(0xE1, b"Exif\0\0" + exif))
    parts.append(segment(0xDB, b"\0" + bytes(table or metadata._STANDARD)))
    return b"".join([*parts, segment(0xDA, b"\0"), scan, b"\xff\xd9"])


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    date = b"2021:05:01 17:23:47\0"
    raw = tiff([(0x010F, 2, 6, b"Canon\0"), (0x0110, 2, 10, b"Canon EOS\0"), (0x0132, 2, 20, b"2020:01:01 00:00:00\0"), (0x9003, 2, 20, date), (0x9291, 2, 3, b"27\0")], order)
    facts = metadata.read_facts(jpeg(raw))
    assert facts["has_exif"] and facts["exif_tags"] == 5 and str(facts["taken"]) == "2021-05-01 17:23:47"
    assert (facts["make"], facts["model"], facts["sub_sec"], facts["jpeg_quality"]) == ("Canon", "Canon EOS", 27, 50)
    assert metadata.read_facts(raw)["exif_tags"] == 5


@pytest.mark.parametrize("quality", [10, 30, 50, 75, 90, 95])
def test_jpeg_quality(quality):
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = [min(255, max(1, int((v * scale + 50) / 100))) for v in metadata._STANDARD]
    assert abs(metadata.read_facts(jpeg(table=table))["jpeg_quality"] - quality) <= 2


def test_damaged_files_have_no_facts():
    whole = jpeg(tiff([(0x010F, 2, 6, b"Canon\0")]))
    for n in range(0, len(whole), 7):
        metadata.read_facts(whole[:n])
    assert not metadata.read_facts(None)["has_exif"]
    assert not metadata.read_facts(b"II*\0\xff\xff\xff\xff")["has_exif"]


def test_splice():
    donor, plain = jpeg(tiff([(0x010F, 2, 6, b"Canon\0")])), jpeg(scan=b"other")
    made = metadata.splice_exif(plain, metadata.extract_exif(donor))
    assert metadata.read_facts(made)["make"] == "Canon"
    assert made.endswith(plain[2:])
    again = metadata.splice_exif(made, metadata.extract_exif(donor))
    assert again == made
