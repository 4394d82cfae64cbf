"""Pairs of rows that share a band of a hash, each found once, as a numpy kernel behind Arrow.

Rows are dealt by their buckets, with all that a pair is judged by, so pairs
themselves are never shuffled. A pair that shares several bands is found in the
first of them only, so none has to be removed later. A bucket of more than TILE
rows is cut into tiles, and each two tiles meet in a group of their own: no
group has more than two tiles' rows, and a row is sent once for each tile of its
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.functions.bits import band_layout, bands

#: Rows of a tile, about; rows that a task takes at a time, at least; pairs that it looks at together, about.
TILE, ROWS, PAIRS = 1 << 14, 1 << 15, 1 << 17
#: From so many partners on, a row is compared with a slice of them.
WIDE = 256
GROUP = ("kind", "band", "key", "x", "y")
FACTS = ("thumb16", "thumb_mean", "contrast", "date_taken", "sub_sec", "prefix", "number")
CANDIDATE, NEAR = "i bigint, j bigint", "i bigint, j bigint, hamming int, thumbnail double, separate boolean"


def keyed(rows: DataFrame, max_hamming: int) -> DataFrame:
    """Each row with each of its bands: kind, band, key. A null hash has none."""
    both = F.concat(bands(F.col("dhash"), max_hamming, 0), bands(F.col("phash"), max_hamming, 1))
    return rows.withColumn("b", F.explode(both)).select("*", "b.*").drop("b").where("key is not null")


def sizes(rows: DataFrame, max_hamming: int) -> DataFrame:
    """(kind, band, key, n) of every bucket."""
    return keyed(rows.select("dhash", "phash"), max_hamming).groupBy("kind", "band", "key").agg(F.count(F.lit(1)).alias("n"))


def dealt(rows: DataFrame, max_hamming: int, max_bucket: int | None) -> DataFrame:
    """Rows by the groups in which they meet: GROUP and ``side``, the tile's place in its group. ``shut``: the row's bands, as bits, that are left out."""
    bucket, found = ["kind", "band", "key"], sizes(rows, max_hamming)
    if max_bucket is None:
        keys = keyed(rows.withColumn("shut", F.lit(0)), max_hamming)
    else:
        full = found.where(F.col("n") > max_bucket).select(*bucket)
        bit = F.expr(f"shiftleft(1, kind * {max_hamming + 1} + band)")
        shut = keyed(rows.select("file_key", "dhash", "phash"), max_hamming).join(full, bucket).groupBy("file_key").agg(F.bit_or(bit).alias("shut"))
        keys = keyed(rows.join(shut, "file_key", "left").withColumn("shut", F.coalesce("shut", F.lit(0))), max_hamming).join(full, bucket, "left_anti")
    large = found.where(F.col("n") > TILE).select(*bucket, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))  # a row for TILE rows at most
    keys = keys.join(F.broadcast(large), bucket, "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("file_key"), "tiles").cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0))))
    met = keys.withColumn("other", other).withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")})
    met = met.withColumn("side", ((F.col("x") < F.col("y")) & (F.col("tile") == F.col("y"))).cast("int")).drop("tiles", "tile", "other")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "side")


def close(d: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the pairs low[a] <= b < high[a] of which one hash or the other differs in ``most`` bits at most; None takes all."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ones(x.shape, bool) if most is None else (np.bitwise_count(x) <= most) | (np.bitwise_count(y) <= most)

    n = high - low
    rows = np.flatnonzero((n > 0) & (n <= WIDE))
    ends = np.cumsum(n[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = n[rows[at:to]]
        a = np.repeat(rows[at:to], own)
        b = np.arange(len(a)) + np.repeat(low[rows[at:to]] - (np.cumsum(own) - own), own)
        some = np.flatnonzero(near(d[a] ^ d[b], p[a] ^ p[b]))
        yield a[some], b[some]
        at = to
    rows = np.flatnonzero(n > WIDE)
    ends = np.append(np.flatnonzero((np.diff(rows) != 1) | (np.diff(high[rows]) != 0)) + 1, len(rows))  # of rows one after another in one group
    at = 0
    while at < len(rows):
        first = rows[at]
        to = min(int(ends[np.searchsorted(ends, at, "right")]), at + max(1, PAIRS // int(n[first])))
        a, b = slice(first, first + to - at), slice(low[first], high[first])
        u, v = np.nonzero(near(d[a, None] ^ d[None, b], p[a, None] ^ p[None, b]))
        u, v = u + first, v + low[first]
        some = v >= low[u]
        yield u[some], v[some]
        at = to


class Rows:
    """Whole groups of dealt rows."""

    def __init__(self, table: pa.Table, max_hamming: int) -> None:
        self.table, self.layout = table, band_layout(max_hamming)
        self.key = self.numbers("file_key")
        self.null = [np.asarray(table.column(h).is_null()) for h in ("dhash", "phash")]
        self.hash = [self.numbers(h).astype(np.uint64) for h in ("dhash", "phash")]
        self.shut = self.numbers("shut")
        self.rank = self.numbers("kind") * len(self.layout) + self.numbers("band")

    def numbers(self, name: str, empty: int = 0) -> np.ndarray:
        return np.asarray(self.table.column(name).fill_null(empty))

    def partners(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that each row meets: those after it, or, in a group of two tiles, those of the other side."""
        n, group = len(self.key), self.table.select(GROUP)
        cut = np.zeros(n, bool)
        cut[:1] = True
        for name in group.column_names:
            x = np.asarray(group.column(name))
            cut[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(cut)
        of = np.cumsum(cut) - 1
        ends = np.append(starts[1:], n)
        side, two = self.numbers("side"), self.numbers("x") < self.numbers("y")
        second = ends - np.add.reduceat(side, starts) if n else ends
        return np.where(two, second[of], np.arange(n) + 1), np.where(side == 1, 0, ends[of])

    def distances(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Bits in which each hash differs; 65 where one is null."""
        return [np.where(null[a] | null[b], 65, np.bitwise_count(h[a] ^ h[b])) for h, null in zip(self.hash, self.null, strict=True)]

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs, those that share no band before the one of their group."""
        left = np.arange(len(a))
        for rank in range(int(self.rank.max(initial=0))):
            (offset, width), h = self.layout[rank % len(self.layout)], self.hash[rank // len(self.layout)]
            null = self.null[rank // len(self.layout)]
            u, v = a[left], b[left]
            same = ((h[u] ^ h[v]) >> np.uint64(offset)) & np.uint64((1 << width) - 1) == 0
            left = left[~(same & (self.rank[u] > rank) & ~null[u] & ~null[v] & (self.shut[u] >> rank & 1 == 0))]
        return left

    def pairs(self, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of each pair, that of the smaller key first."""
        for a, b in close(*self.hash, *self.partners(), most):
            if most is not None and (self.null[0].any() or self.null[1].any()):
                some = np.minimum(*self.distances(a, b)) <= most
                a, b = a[some], b[some]
            some = self.first(a, b)
            a, b = a[some], b[some]
            some = self.key[a] != self.key[b]
            a, b = a[some], b[some]
            turned = self.key[a] > self.key[b]
            a, b = np.where(turned, b, a), np.where(turned, a, b)
            for at in range(0, len(a), PAIRS):
                yield a[at : at + PAIRS], b[at : at + PAIRS]


class Facts:
    """What pairs are judged by, beside their hashes."""

    def __init__(self, rows: Rows) -> None:
        column = rows.table.column
        thumbs = column("thumb16").combine_chunks()
        self.size = np.asarray(thumbs.value_lengths().fill_null(-1)).astype(np.int64)
        flat = thumbs.flatten()
        values = np.asarray(flat if pa.types.is_int16(flat.type) else flat.cast(pa.float64()))
        n = np.maximum(self.size, 0)
        starts = np.cumsum(n) - n
        self.thumbs = np.zeros((int(n.max(initial=0)), len(n)), values.dtype)  # a row a cell; small integers stay so until a pair is judged
        for k, cell in enumerate(self.thumbs):
            some = np.flatnonzero(n > k)
            cell[some] = values[starts[some] + k]
        self.mean, self.spread = (np.asarray(column(c).cast(pa.float64()).fill_null(np.nan)) for c in ("thumb_mean", "contrast"))
        self.time = [(np.asarray(column(c).is_null()), rows.numbers(c)) for c in ("date_taken", "sub_sec")]
        # texts as numbers, equal ones alike; the empty one is 0
        self.prefix, self.number = (np.asarray(pa.chunked_array([pa.array([""]), *column(c).fill_null("").cast(pa.string()).chunks]).combine_chunks().dictionary_encode().indices)[1:] for c in ("prefix", "number"))

    def thumbnail(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean absolute difference once b has the mean and spread of a, summed in the order of the cells; nan for arrays of different sizes."""
        size, mean, other, low = self.size[a], self.mean[a], self.mean[b], self.spread[b] < 1e-6
        gain = np.where(low, 1.0, self.spread[a] / np.where(low, 1.0, self.spread[b]))
        total, whole = np.zeros(len(a)), bool((self.size == len(self.thumbs)).all())
        for k, cell in enumerate(self.thumbs):
            part = np.abs(cell[a] - ((cell[b] - other) * gain + mean))
            total += part if whole else np.where(k < size, part, 0.0)
        return np.where((size == self.size[b]) & (size > 0), total / np.maximum(size, 1), np.nan)

    def separate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two exposures by what the pictures don't show: capture times that differ, or numbers of one series where a time is missing."""
        (undated, date), (whole, part) = self.time
        timed = (date[a] != date[b]) | (~whole[a] & ~whole[b] & (part[a] != part[b]))
        frames = (self.prefix[a] != 0) & (self.prefix[a] == self.prefix[b]) & (self.number[a] != 0) & (self.number[b] != 0) & (self.number[a] != self.number[b])
        return np.where(undated[a] | undated[b], frames, timed)


def _groups(batches: Iterator[pa.RecordBatch], max_hamming: int) -> Iterator[Rows]:
    """Sorted rows, whole groups together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for name in GROUP:
            x = np.asarray(table.column(name))
            last &= x == x[-1]
        cut = n - int(last.sum())
        if cut:
            yield Rows(table.slice(0, cut).combine_chunks(), max_hamming)
        held = table.slice(cut).combine_chunks().to_batches()
        n -= cut
    if n:
        yield Rows(pa.Table.from_batches(held).combine_chunks(), max_hamming)


def candidates(rows: DataFrame, max_hamming: int, max_bucket: int | None = None) -> DataFrame:
    """(i, j), i < j, of all rows (file_key, dhash, phash) that share a band, each pair once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, max_hamming):
            for a, b in part.pairs(None):
                yield pa.RecordBatch.from_arrays([pa.array(part.key[a]), pa.array(part.key[b])], ["i", "j"])

    return dealt(rows.select("file_key", "dhash", "phash"), max_hamming, max_bucket).mapInArrow(found, CANDIDATE)


def near(rows: DataFrame, max_hamming: int, max_bucket: int | None = None) -> DataFrame:
    """(i, j, hamming, thumbnail, separate) of the pairs within max_hamming. rows: the columns of candidates, and FACTS, prefixes in lower case."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, max_hamming):
            facts = Facts(part)
            for a, b in part.pairs(max_hamming):
                thumbnail = facts.thumbnail(a, b)
                columns = [pa.array(part.key[a]), pa.array(part.key[b]), pa.array(np.minimum(*part.distances(a, b)).astype(np.int32))]
                columns += [pa.array(thumbnail, pa.float64(), mask=np.isnan(thumbnail)), pa.array(facts.separate(a, b))]
                yield pa.RecordBatch.from_arrays(columns, ["i", "j", "hamming", "thumbnail", "separate"])
            del part, facts  # before the next ones are made

    return dealt(rows.select("file_key", "dhash", "phash", *FACTS), max_hamming, max_bucket).mapInArrow(found, NEAR)
