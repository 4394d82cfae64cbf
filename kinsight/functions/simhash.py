"""Simhashes of words and word pairs and letter shares of texts, as a numpy kernel behind Arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LETTERS = 60, 26
#: Texts that are taken together; words whose numbers a task remembers, about.
TEXTS, KNOWN = 250, 100_000
VOTES = "file_key bigint, votes array<int>, thumb16 array<smallint>"
#: The bits of a byte, the lowest first, in a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def numbers(texts: Iterable[bytes]) -> np.ndarray:
    """The first 60 bits of each text's md5."""
    return np.frombuffer(b"".join([md5(t).digest() for t in texts]), ">u8")[::2].astype(np.uint64) >> np.uint64(4)


def votes(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text, at each bit, how many more of its numbers have it than not. sizes: numbers of each text, 1 at least."""
    parts = -(-sizes // 255)  # a lane holds so many ones
    of = np.repeat(np.arange(len(sizes)), parts)
    starts = np.cumsum(sizes) - sizes
    cuts = starts[of] + 255 * (np.arange(len(of)) - (np.cumsum(parts) - parts)[of])
    lanes = np.add.reduceat(_LANES[numbers.astype("<u8").view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    return 2 * ones[:, :BITS] - sizes[:, None]


class _Numbered(dict):
    """Words by the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Hasher:
    """Votes of the words and word pairs of texts; a text of one word has that as its only pair."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.ids, self.words, self.first, self.of_word = _Numbered(), [], [], np.zeros(0, np.uint64)

    def both(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KNOWN:
            self.forget()
        split = [t.split(" ") for t in texts]
        sizes = np.array([len(w) for w in split])
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        new = [w.encode() for w in islice(self.ids, len(self.words), None)]
        self.words += new
        self.first += [w + b" " for w in new]
        self.of_word = np.concatenate((self.of_word, numbers(new)))
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        alone = np.repeat(sizes == 1, sizes)
        keys, at = np.unique((ids[:-1] << 32 | ids[1:])[~last[:-1]], return_inverse=True)
        first, words = self.first, self.words
        of_pair = np.zeros(len(ids), np.uint64)
        of_pair[~last] = numbers([first[a] + words[b] for a, b in zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True)])[at]
        of_pair[alone] = self.of_word[ids[alone]]
        return votes(self.of_word[ids], sizes), votes(of_pair[~last | alone], np.maximum(sizes - 1, 1))


def letters(texts: list[str], n_chars: np.ndarray) -> np.ndarray:
    """Shares of a to z, in thousandths."""
    raw = [t.encode() for t in texts]
    code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    found = np.bincount(np.repeat(np.arange(len(raw)) << 8, [len(r) for r in raw]) + code, minlength=len(raw) << 8)
    return found.reshape(-1, 256)[:, 97:123] * 1000 // np.maximum(n_chars, 1)[:, None]


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for whole in batches:
        for start in range(0, whole.num_rows, TEXTS):
            part = whole.slice(start, TEXTS)
            texts = part.column("text").to_pylist()
            found = np.concatenate(hasher.both(texts), axis=1)
            shares = letters(texts, np.asarray(part.column("n_chars").fill_null(1)).astype(np.int64))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()).cast(kind))
            yield pa.RecordBatch.from_arrays([part.column("file_key"), lists(found, pa.int32()), lists(shares, pa.int16())], ["file_key", "votes", "thumb16"])


def voted(texts: DataFrame) -> DataFrame:
    """file_key, votes (of words, then of pairs) and thumb16 of rows (file_key, text in lower case, n_chars); rows without a key or a text have none."""
    return texts.where("file_key is not null and text is not null").mapInArrow(_voted, VOTES)


def simhash(first: int) -> Column:
    """The bits that most of a group's votes have, from the vote ``first`` on."""
    total = F.lit(0).cast("bigint")
    for b in range(BITS):
        total = total + F.when(F.sum(F.get("votes", F.lit(first + b))) > 0, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return total
