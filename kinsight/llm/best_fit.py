"""Best-fit packing of token sequences, online and in bounded space.

A packer keeps at most BINS open sequences, in lists by free space; one bit of
an integer marks each free space that has any, so the tightest sequence that
still takes a piece is found by a shift and a count of trailing zeros. When too
many are open, the fullest closes. Each task packs what it reads, batch by
batch with the longest pieces of a batch first, so nothing is shuffled and the
memory is one batch. A task leaves its open sequences part-filled, at most
BINS, so input partitions are joined until a task has PACKER_BYTES of input:
how the input is split then matters little to how many sequences come out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_counts import byte_characters

LENGTH = 2048
#: Open sequences of a packer.
BINS = 512
#: Bytes of input that a task packs at least, as Spark estimates its size; the input's last task may have less.
PACKER_BYTES = 16 << 20
#: Token id that ends each document.
END = 0
#: Words, and pieces of words, whose ids a Python worker remembers; all are forgotten when full.
REMEMBERED, REMEMBERED_PIECES = 600_000, 300_000
#: Words that normalizing only lower-cases, and their pieces: contractions, runs of letters, digits, runs of other signs (fixed values of the vocabulary's rules).
PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+\Z")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts, word by word with a memory of words.

    The vocabulary's rules drop white space and never join what it separates,
    so a text's ids are its words' ids in a row. Plain words are cut into
    pieces here and only the pieces go to the vocabulary's model; all others
    take the tokenizer's own way. A vocabulary of other rules is found out by a
    trial when it is loaded, and has all words take that way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.table = byte_characters()
        signs = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100)) if PLAIN.match(chr(c))]
        trial = [*signs, *(f"aB{c}d{c}{c}1x" for c in signs), "it's", "x'LL'd--'s", "'s't", "Été12,34..."]
        self.fast = all(self._plain(w) == self._whole(w) for w in trial if "<|" not in w)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """One for each Python worker, kept between tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        out, known = [], self.pieces
        for piece in PIECE.findall(word.lower()):
            ids = known.get(piece)
            if ids is None:
                spelled = piece if piece.isascii() else "".join([self.table[b] for b in piece.encode()])
                ids = known[piece] = np.array([x.id for x in self.tokenizer.model.tokenize(spelled)], dtype="<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def _encode(self, raw: bytes) -> bytes:
        word = raw.decode()
        return self._plain(word) if self.fast and PLAIN.match(word) and "<|" not in word else self._whole(word)

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text has none."""
        known = self.known
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces.clear()
        if len(known) > REMEMBERED:
            known.clear()
        for text in texts:
            words = (text or b"").split()
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = self._encode(w)
                yield b"".join(map(known.__getitem__, words))


class Packer:
    """Places pieces one after the other; see the module."""

    def __init__(self, first: int, length: int = LENGTH, bins: int = BINS) -> None:
        self.length, self.bins = length, bins
        self.next = first
        self.by_free: dict[int, list[int]] = {}
        self.free = 0  # bit f: a sequence with f free places is open
        self.open = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fits = self.free >> size
        if fits:
            left = size + ((fits & -fits).bit_length() - 1)
            same = self.by_free[left]
            sequence = same.pop()
            if not same:
                self.free &= ~(1 << left)
            self.open -= 1
        else:
            left, sequence = self.length, self.next
            self.next += 1
        rest = left - size
        if rest:
            self.by_free.setdefault(rest, []).append(sequence)
            self.free |= 1 << rest
            self.open += 1
            if self.open > self.bins:
                least = (self.free & -self.free).bit_length() - 1
                self.by_free[least].pop(0)
                if not self.by_free[least]:
                    self.free &= ~(1 << least)
                self.open -= 1
        return sequence, self.length - left


def _gathered(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """rows over no more partitions than docs has multiples of ``size`` bytes; partitions are joined, not shuffled. An unknown size leaves them."""
    estimate = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.coalesce(min(max(1, -(-estimate // size)), (1 << 31) - 1))


SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bins: int = BINS, packer_bytes: int = PACKER_BYTES) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A document's ids end with END, so a null or empty text is one piece of one
    id. Only documents longer than ``length`` are cut. Repeated rows and null
    ids are packed as any others; an empty table gives no rows. Other columns
    are not read. A sequence's number holds its task's partition, so a task
    that runs again gives the same rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, length, bins)
        end = np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                pieces = []
                keys = batch.column(0).to_pylist()
                for key, ids in zip(keys, encoder.ids(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids) // 4, length):
                        part = ids[4 * k : 4 * (k + length)]
                        pieces.append((key, k // length, k, len(part) // 4, part))
                places: list[tuple[int, int]] = [(0, 0)] * len(pieces)
                for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][3]):
                    places[i] = packer.place(pieces[i][3])
                columns = [*zip(*pieces, strict=True), *zip(*places, strict=True)] if pieces else [[]] * 7
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return _gathered(docs, rows, packer_bytes).mapInArrow(packed, SCHEMA)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack of all of documents, with the digests of the pieces; it says how odd rows are taken."""
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
