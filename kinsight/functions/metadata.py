"""Metadata embedded in pictures and beside them: JPEG segments, TIFF tags, sidecar files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN_BYTES, MOST_ENTRIES, MOST_ASCII = 256 * 1024, 512, 256
#: The metadata reader's version, which rows carry as meta_state.
META_STATE = 4

# Fixed values of the file formats: TIFF tags, and the luminance table of JPEG's Annex K in its natural order.
MAKE, MODEL, ORIENTATION, DATE, EXIF_IFD, GPS_IFD, DATE_ORIGINAL, SUB_SECOND = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x8825, 0x9003, 0x9291
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)


def _zigzag() -> list[int]:
    """The luminance table along the anti-diagonals, turning at each end."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return [LUMINANCE[y][x] for y, x in cells]


_STANDARD = _zigzag()


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, marker, length with the marker) of the segments before a JPEG's image data, the start of scan last."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker == 0xD9:
            return
        length = int.from_bytes(data[at + 2 : at + 4], "big") + 2
        if length < 4 or at + length > len(data):
            return
        yield at, marker, length
        if marker == 0xDA:
            return
        at += length


def quality_of(table: bytes) -> int | None:
    """The quality a quantization table (its id byte first) was made with; null for 16-bit and saturated ones."""
    if len(table) < 65 or table[0] >> 4:
        return None
    ratios = [100.0 * v / s for v, s in zip(table[1:65], _STANDARD, strict=True) if 1 < v < 255]
    if len(ratios) < 8:
        return None
    scale = sum(ratios) / len(ratios)
    return min(100, max(1, round(5000 / scale if scale > 100 else (200 - scale) / 2)))


class Tiff:
    """Tags of a TIFF block: those of the first directory and of the EXIF directory it points to."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.order = raw, ">" if raw[:1] == b"M" else "<"
        self.count, self.make, self.model, self.taken, self.original = 0, None, None, None, False
        self.sub_second, self.gps, self.orientation, self.exif = None, False, 0, 0
        if len(raw) >= 8 and self._number(2, "H") == 42:
            self._walk(self._number(4, "I"))
            if self.exif:
                self._walk(self.exif)

    def _number(self, at: int, kind: str) -> int:
        return struct.unpack_from(self.order + kind, self.raw, at)[0]

    def _text(self, entry: int, size: int) -> str | None:
        if not 0 < size <= MOST_ASCII:
            return None
        at = entry + 8 if size <= 4 else self._number(entry + 8, "I")
        if at + size > len(self.raw):
            return None
        return self.raw[at : at + size].split(b"\0")[0].decode("ascii", "replace").strip() or None

    def _walk(self, at: int) -> None:
        if not at or at + 2 > len(self.raw):
            return
        n = self._number(at, "H")
        if n > MOST_ENTRIES:
            return
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            if entry + 12 > len(self.raw):
                return
            tag, kind, size = self._number(entry, "H"), self._number(entry + 2, "H"), self._number(entry + 4, "I")
            self.count += 1
            if tag == EXIF_IFD:
                self.exif = self._number(entry + 8, "I")
            elif tag == GPS_IFD:
                self.gps = self._number(entry + 8, "I") != 0
            elif tag == ORIENTATION and kind == 3:
                self.orientation = self._number(entry + 8, "H")
            elif tag == MAKE:
                self.make = self._text(entry, size)
            elif tag == MODEL:
                self.model = self._text(entry, size)
            elif tag == SUB_SECOND:
                text = self._text(entry, size) or ""
                self.sub_second = int(text) if text.isdigit() else self.sub_second
            elif tag in (DATE, DATE_ORIGINAL):
                self._date(self._text(entry, size), tag == DATE_ORIGINAL)

    def _date(self, text: str | None, original: bool) -> None:
        try:
            found = datetime.strptime((text or "").strip(), "%Y:%m:%d %H:%M:%S")
        except ValueError:
            return
        if self.taken is None or (original and not self.original):
            self.taken, self.original = found, original


FACTS = "has_exif boolean, exif_tags int, taken timestamp_ntz, sub_sec int, make string, model string, has_gps boolean, orientation int, jpeg_quality int, meta_bytes int"
_NAMES = [x.split()[0] for x in FACTS.split(", ")]


def read_facts(data: bytes | None) -> dict:
    """Facts of a JPEG or TIFF file's first bytes; of anything else, none."""
    data = bytes(data or b"")[:SCAN_BYTES]
    facts = dict.fromkeys(_NAMES) | {"has_exif": False, "exif_tags": 0, "has_gps": False, "orientation": 0, "meta_bytes": 0}
    tiff = None
    if data[:2] in (b"II", b"MM"):
        tiff = Tiff(data)
    elif data[:2] == b"\xff\xd8":
        for start, marker, length in segments(data):
            body = data[start + 4 : start + length]
            if 0xE0 <= marker <= 0xEF or marker == 0xFE:
                facts["meta_bytes"] += length
            if marker == 0xE1 and len(body) > 6 and body[:4] == b"Exif":
                tiff = Tiff(body[6:])
            if marker == 0xDB and facts["jpeg_quality"] is None:
                facts["jpeg_quality"] = quality_of(body)
    if tiff is not None:
        facts |= {"has_exif": tiff.count > 0, "exif_tags": tiff.count, "taken": tiff.taken, "sub_sec": tiff.sub_second}
        facts |= {"make": tiff.make, "model": tiff.model, "has_gps": tiff.gps, "orientation": tiff.orientation}
    return facts


def picture_facts(content: Column) -> Column:
    """Struct of FACTS of file contents; only the first SCAN_BYTES are looked at."""

    @F.pandas_udf(FACTS)
    def facts(contents: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([read_facts(x) for x in contents], columns=_NAMES)
        found["taken"] = pd.to_datetime(found["taken"])
        return found.astype({"sub_sec": "Int32", "jpeg_quality": "Int32"})

    return facts(F.substring(content, 1, SCAN_BYTES))


def _exif_segment(data: bytes) -> tuple[int, int] | None:
    for start, marker, length in segments(data):
        if marker == 0xE1 and data[start + 4 : start + 10] == b"Exif\0\0":
            return start, length
    return None


def extract_exif(data: bytes) -> bytes | None:
    """The first EXIF segment, marker and all."""
    found = _exif_segment(data)
    return None if found is None else data[found[0] : found[0] + found[1]]


def splice_exif(data: bytes, segment: bytes) -> bytes:
    """A JPEG with this EXIF segment first and none of its own; all else stays byte for byte."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no start-of-image marker")
    own = [(s, n) for s, marker, n in segments(data) if marker == 0xE1 and data[s + 4 : s + 10] == b"Exif\0\0"]
    parts, at = [data[:2], segment], 2
    for start, length in own:
        parts.append(data[at:start])
        at = start + length
    return b"".join([*parts, data[at:]])


def exif_spliced(content: Column, donor: Column) -> Column:
    """content with the EXIF of donor; null where content is no JPEG or donor has none."""

    def one(x: bytes | None, y: bytes | None) -> bytes | None:
        segment = extract_exif(bytes(y)) if y is not None else None
        return None if x is None or segment is None or bytes(x[:2]) != b"\xff\xd8" else splice_exif(bytes(x), segment)

    @F.pandas_udf("binary")
    def spliced(contents: pd.Series, donors: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(contents, donors, strict=True)], dtype=object)

    return spliced(content, donor)


def exif_date(text: Column) -> Column:
    return F.try_to_timestamp(F.rtrim(F.trim(text)), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def takeout_facts(json: Column) -> Column:
    """struct<taken bigint, has_gps, description> of a photo service's JSON sidecar: the photo's time before the creation's, positive ones only."""

    def seconds(name: str) -> Column:
        n = F.get_json_object(json, f"$.{name}.timestamp").try_cast("bigint")
        return F.when(n > 0, n)

    place = [F.get_json_object(json, f"$.geoData.{k}").try_cast("double") for k in ("latitude", "longitude")]
    gps = F.coalesce((place[0] != 0) | (place[1] != 0), F.lit(False))
    return F.struct(
        F.coalesce(seconds("photoTakenTime"), seconds("creationTime")).alias("taken"), gps.alias("has_gps"), F.get_json_object(json, "$.description").alias("description")
    )


XMP_FIELDS = ("exif:DateTimeOriginal", "photoshop:DateCreated", "xmp:CreateDate")


def xmp_facts(text: Column) -> Column:
    """struct<taken string, has_gps> of an XMP sidecar: the first of XMP_FIELDS, as an attribute or an element."""
    tries = []
    for name in XMP_FIELDS:
        for pattern in (f'(?i){name}="([^"<]+)', f'(?i)<{name}>([^"<]+)'):
            found = F.regexp_extract(text, pattern, 1)
            tries.append(F.when(found != "", found))
    return F.struct(F.coalesce(*tries).alias("taken"), text.contains("exif:GPSLatitude").alias("has_gps"))


def merged(embedded: Column, sidecar: Column, filename: Column) -> Column:
    """The best capture time: embedded before sidecar before file name."""
    return F.coalesce(embedded, sidecar, filename)


def sidecar_names(rel_path: Column) -> Column:
    """Candidate sidecars of a picture, best first."""
    bare = F.regexp_replace(rel_path, r"\.[^.\\]*$", "")
    ends = ((rel_path, ".json"), (rel_path, ".supplemental-metadata.json"), (bare, ".json"), (rel_path, ".xmp"), (bare, ".xmp"))
    return F.array(*[F.concat(p, F.lit(e)) for p, e in ends])
