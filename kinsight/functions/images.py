"""Fingerprints of gray squares and difference maps, as numpy kernels behind Arrow UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, THUMB, DCT, KEPT = 64, 16, 32, 8

_ANGLES = (2 * np.arange(DCT)[None, :] + 1) * np.arange(KEPT)[:, None] * np.pi / (2 * DCT)
_COSINES = np.cos(_ANGLES)


def _shrunk(square: np.ndarray, size: int) -> np.ndarray:
    k = square.shape[0] // size
    return square.reshape(size, k, size, k).sum(axis=(1, 3)) // (k * k)


def _cells(square: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area means on a grid that need not divide the square."""
    n = square.shape[0]
    sums = np.zeros((n + 1, n + 1), dtype=np.int64)
    sums[1:, 1:] = square.cumsum(axis=0).cumsum(axis=1)
    ys, xs = np.arange(height + 1) * n // height, np.arange(width + 1) * n // width
    area = np.diff(ys)[:, None] * np.diff(xs)[None, :]
    corners = sums[np.ix_(ys, xs)]
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) // area


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0])


def gradient_hash(square: np.ndarray) -> int:
    """64 bits: whether a cell is brighter than its right neighbour, on a grid of 9 x 8."""
    grid = _cells(square, 9, 8)
    return _packed((grid[:, :-1] > grid[:, 1:]).ravel())


def _frequency_hash(square: np.ndarray) -> int:
    small = _shrunk(square, DCT).astype(np.float64)
    found = (_COSINES @ small @ _COSINES.T).ravel()
    rest = np.sort(found[1:])
    middle = len(rest) // 2
    return _packed(found > (rest[middle - 1] + rest[middle]) / 2)  # the mean of the two below the true median, by definition of the hash


def frequency_hash(square: np.ndarray) -> int:
    """The least of the hashes of the four quarter turns, so that it does not depend on them."""
    return min(_frequency_hash(np.rot90(square, k)) for k in range(4))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


FINGERPRINT = "dhash bigint, phash bigint, thumb16 array<smallint>, contrast double, pixel_hash string"


def _fingerprint(gray: np.ndarray, width: int, height: int) -> dict:
    square = np.asarray(gray, dtype=np.int64).reshape(SIDE, SIDE)
    raw = square.astype(np.uint8).tobytes() + np.array([width, height], dtype="<i4").tobytes()
    return {
        "dhash": _signed(gradient_hash(square)),
        "phash": _signed(frequency_hash(square)),
        "thumb16": _shrunk(square, THUMB).ravel().tolist(),
        "contrast": float(square.std()),
        "pixel_hash": hashlib.md5(raw).hexdigest().upper(),
    }


def fingerprint(gray: Column, width: Column, height: Column) -> Column:
    """Struct of a 64 x 64 gray square's fingerprint (row by row) and the picture's own size. Null or misshapen input gives nulls."""
    empty = dict.fromkeys(("dhash", "phash", "thumb16", "contrast", "pixel_hash"))

    @F.pandas_udf(FINGERPRINT)
    def made(squares: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
        rows = [
            empty if g is None or len(g) != SIDE * SIDE or pd.isna(w) or pd.isna(h) else _fingerprint(g, int(w), int(h))
            for g, w, h in zip(squares, widths, heights, strict=True)
        ]
        return pd.DataFrame(rows, columns=list(empty)).astype({"dhash": "Int64", "phash": "Int64"})

    return made(gray, width, height)


def _match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gain = 1.0 if b.std() < 1e-6 else a.std() / b.std()
    return np.clip((b - b.mean()) * gain + a.mean(), 0, 255).astype(np.int64)


def kind_of(mean: float, concentration: float, edge: float) -> str:
    if mean < 1:
        return "Identical"
    if mean > 40:
        return "Different"
    if edge > 0.65 and concentration < 0.55:
        return "Cropped"
    if concentration > 0.5:
        return "Moved"
    if concentration < 0.32 or mean < 6:
        return "Recompressed"
    return "Moved"


#: What each kind is reported as.
VERDICTS = {
    "Identical": "the pictures look the same",
    "Recompressed": "small differences all over: another encoding or size of one shot",
    "Moved": "one area differs: the scene changed between two shots",
    "Cropped": "the borders differ: one picture shows a part of the other",
    "Different": "most of the picture differs: two photographs",
}
DEAD_ZONE, VISIBLE, BUSIEST = 2, 6, 0.10


def gray_of(bgr: np.ndarray) -> np.ndarray:
    """Rec. 601 luma of [..., 3] blue, green, red bytes, in integers."""
    x = bgr.astype(np.int64)
    return (x[..., 2] * 299 + x[..., 1] * 587 + x[..., 0] * 114) // 1000


def nearest(source: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = source.shape
    return source[np.minimum(h - 1, np.arange(height) * h // height)[:, None], np.minimum(w - 1, np.arange(width) * w // width)[None, :]]


def difference(a: np.ndarray, b: np.ndarray) -> dict:
    """Mean difference, concentration, edge share, changed area and kind of two gray pictures; b is laid on a's grid and brightness."""
    h, w = a.shape
    a = a.astype(np.int64)
    d = np.abs(a - _match(a, nearest(b, h, w).astype(np.int64)))
    total = int(d.sum())
    busiest = max(1, int(d.size * BUSIEST))
    counts = np.bincount(d.ravel(), minlength=256)[::-1]
    taken = np.diff(np.minimum(np.cumsum(counts), busiest), prepend=0)
    inner = d[max(1, h // 5) : h - max(1, h // 5), max(1, w // 5) : w - max(1, w // 5)]
    concentration = float((taken * np.arange(255, -1, -1)).sum() / total) if total else 0.0
    edge = float((total - inner.sum()) / total) if total else 0.0
    mean = total / d.size
    kind = kind_of(mean, concentration, edge)
    return {"mean": mean, "concentration": concentration, "edge": edge, "changed": float((d >= VISIBLE).mean()), "kind": kind, "verdict": VERDICTS[kind], "separate": kind in ("Moved", "Different")}


def heat_map(d: np.ndarray) -> np.ndarray:
    """BGRA picture of a difference: black inside the dead zone, then dark red to yellow to white."""
    level = np.clip((d.astype(np.float64) - DEAD_ZONE) / max(1, int(d.max()) - DEAD_ZONE), 0, 1)
    out = np.zeros((*d.shape, 4), dtype=np.uint8)
    for channel, start in ((2, 0.0), (1, 1 / 3), (0, 2 / 3)):
        out[..., channel] = np.clip((level - start) * 3 * 255, 0, 255)
    out[..., 3] = 255
    return out


DIFFERENCE = "mean double, concentration double, edge double, changed double, kind string, verdict string, separate boolean"


def difference_map(df: DataFrame, a: str, b: str, width: str, height: str) -> DataFrame:
    """Add the columns of DIFFERENCE for two gray arrays of width x height each; null arrays give nulls."""
    names = [x.split()[0] for x in DIFFERENCE.split(", ")]

    @F.pandas_udf(DIFFERENCE)
    def compared(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for first, second, ws, hs in batches:
            rows = []
            for x, y, w, h in zip(first, second, ws, hs, strict=True):
                good = x is not None and y is not None and len(x) == len(y) == w * h > 0
                rows.append(difference(np.asarray(x).reshape(h, w), np.asarray(y).reshape(h, w)) if good else dict.fromkeys(names))
            yield pd.DataFrame(rows, columns=names)

    return df.withColumn("__d", compared(a, b, width, height)).select("*", "__d.*").drop("__d")


def spread(values: Column) -> Column:
    """Population deviation of an array, by running means (Welford): the same steps as DuckDB's list_stddev_pop, so the same last bits."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "q")])

    def step(a: Column, v: Column) -> Column:
        mean = a["mean"] + (v - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["q"] + (v - mean) * (v - a["mean"])).alias("q"))

    return F.aggregate(values, start, step, lambda a: F.sqrt(a["q"] / a["n"]))
