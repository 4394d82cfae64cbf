"""Column functions on 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_layout(max_distance: int) -> list[tuple[int, int]]:
    """(offset, width) of max_distance + 1 bands over 64 bits, low bits first, the wider ones first."""
    n = max_distance + 1
    base, extra = divmod(64, n)
    layout, at = [], 0
    for k in range(n):
        width = base + (k < extra)
        layout.append((at, width))
        at += width
    return layout


def bands(h: Column, max_distance: int, kind: int) -> Column:
    """array<struct<kind, band, key>>: two hashes within max_distance have a band in common, by the pigeonhole principle."""
    parts = []
    for k, (offset, width) in enumerate(band_layout(max_distance)):
        key = F.shiftrightunsigned(h, offset)
        key = key.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else key
        parts.append(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("band"), key.alias("key")))
    return F.array(*parts)
