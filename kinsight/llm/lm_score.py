"""LM scoring by online logistic context mixing.

A text has a kind, told from its letters by a few thresholds that split the
training texts where they differ most, and coded first. Then it is a sequence of
symbols, coded as bits of a binary tree (a Huffman tree, so a token takes about
four). A word's symbol is the logarithm of its count in the training texts of
the kind; further ones are the end, a word of other kinds and a word that
training lacks. Each bit is predicted in CONTEXTS contexts by tables that the training texts have filled.
The predictions are combined in the logistic domain with weights of a gate, the
weights follow the coding error as the text is read (online), and an adaptive
map of the text's own refines the result.

The bits leave several words, which further bits of the same kind tell apart:

- the words of a symbol are numbered, and the bits of the word's number follow,
  each predicted by hashed contexts: its place among the numbers, and that with
  the last symbol, the last word, the last two words, and what the word says that
  followed the last two when the text had them before, the candidate;
- words that training lacks are split, by one more bit, into those that the text
  had, which are numbered as they came, and new ones, which are spelled bit by
  bit, predicted by the last one to four bytes.

All bits of a text, of symbols, numbers and spellings, go through one mixer in
the order of the text: weights of the bit's gate, learned while the text is
read, and the adaptive map. None is taken from a count alone.

The end is one of the symbols, so all continuations of a text share one
distribution (words that training has could be spelled, too: that part is lost).

The tables are learned as a held-out text would see them: of a training text's
words, its own occurrences are left out of the counts. Every text starts from
the same tables and weights and learns only from itself. Weights are set once
every SEGMENT bits of a text, from the bits before; texts of a block advance
together. Contexts of symbols are made of symbols, positions and matches, so
nothing collides in their tables; those of numbers and spellings are hashed to
tables of fixed size and share slots on large inputs; the vocabulary grows with
the corpus. Texts are encoded in blocks with a dictionary each; dictionaries, not
tokens, are dealt by their words' hashes to parts of bounded size, where words
are counted (by their bytes, not their hashes) and each block's counts sent back.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .hashing import mixed

#: Documents of this remainder of crc32(doc_id) are held out.
MODULUS, HELD_OUT = 7, 2
#: Bytes of text in a block, about; a block holds whole texts.
BLOCK_BYTES = 4 << 20
#: Bits between two updates of a text's weights; texts that are mixed at a time.
SEGMENT, MIXED_ROWS = 128, 64
#: Slots of the spelling tables, one table an order.
SPELL_BITS, ORDERS = 18, 4
SPELL_RATE = 0.02
#: Bytes of the dictionaries' words that a part counts, about.
PART_BYTES = 8 << 20
#: Levels of the thresholds that tell a text's kind.
KIND_LEVELS = 3
GATES = 8
#: Slots of the tables of the numbers' bits, one table a context; what a context leans on the one before it, in outcomes.
NUMBER_BITS, NUMBER_TABLES, LEAN = 20, 4, 2.0
LOG10 = math.log(10)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % MODULUS == HELD_OUT


def repeats(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, how often its text had it before, and has it. ids: token numbers, doc: the text's number, ascending."""
    key = doc.astype(np.int64) << 32 | ids.astype(np.int64)
    order = np.argsort(key, kind="stable")
    a = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((cuts, [len(a)])))
    out = np.empty((2, len(a)), dtype=np.int64)
    out[0, order] = np.arange(len(a)) - np.repeat(cuts, sizes)
    out[1, order] = np.repeat(sizes, sizes)
    return out[0], out[1]


# ---- kinds of texts --------------------------------------------------------

_LETTER = np.full(256, 26, np.int64)
_LETTER[np.arange(97, 123)] = _LETTER[np.arange(65, 91)] = np.arange(26)


def letters(texts: list[bytes]) -> np.ndarray:
    """The share of each letter a to z among those of each text."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), 27))
    ends = np.cumsum(sizes)
    a = 0
    while a < len(texts):  # about a MB at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
        code = _LETTER[np.frombuffer(b"".join(texts[a:b]), np.uint8)]
        out[a:b] = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]) * 27 + code, minlength=27 * (b - a)).reshape(-1, 27)
        a = b
    out = out[:, :26]
    return out / np.maximum(1, out.sum(axis=1, keepdims=True))


def kinds_of(shares: np.ndarray, cuts: dict[int, tuple[int, float]]) -> np.ndarray:
    """The kind of each text, a path through the thresholds: the node's bit is whether its letter has a greater share."""
    node = np.ones(len(shares), np.int64)
    while len(node) and (int(node.max()) in cuts or int(node.min()) in cuts):
        letter = np.array([cuts[int(n)][0] if int(n) in cuts else 0 for n in range(int(node.max()) + 1)])[node]
        above = shares[np.arange(len(node)), letter] > np.array([cuts[int(n)][1] if int(n) in cuts else 0 for n in range(int(node.max()) + 1)])[node]
        node = 2 * node + above
    return node


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            part = whole.slice(at, 1000)
            found = letters([t or b"" for t in part.column("text").to_pylist()])
            use = pa.array([not held_out(k) for k in part.column("doc_id").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), use], ["shares", "use"]).filter(use)


def _sums(cuts: dict[int, tuple[int, float]]):
    """For each node: texts, sums and sums of squares of the letters' shares; a row a task and node."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("shares").to_pylist())).reshape(-1, 26)
            node = kinds_of(x, cuts)
            for n in np.unique(node):
                own = x[node == n]
                total[int(n)] = total.get(int(n), 0) + np.concatenate(([len(own)], own.sum(axis=0), (own * own).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["node", "sums"])

    return summed


def text_kinds(own: DataFrame, levels: int = KIND_LEVELS) -> tuple[dict[int, tuple[int, float]], dict[int, float], int]:
    """(thresholds, log10 of each kind's share, number) of the training texts: at each node the letter of the greatest variance is split at its mean."""
    shares = stored(own.mapInArrow(_shares, "shares binary, use boolean"), "shares")
    cuts: dict[int, tuple[int, float]] = {}
    for level in range(levels + 1):
        each = shares.mapInArrow(_sums(cuts), "node bigint, sums array<double>")
        found = each.groupBy("node").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(53)]).collect()
        sums = {r[0]: np.array(r[1:]) for r in found}
        if level < levels:
            for node in range(1 << level, 2 << level):
                s = sums.get(node, np.zeros(53))
                mean = s[1:27] / max(1, s[0])
                letter = int(np.argmax(s[27:] / max(1, s[0]) - mean * mean))
                cuts[node] = letter, float(round(mean[letter], 6))
    n = {node: sums[node][0] if node in sums else 0 for node in range(1 << levels, 2 << levels)}
    return cuts, {node: math.log10((x + 1) / (sum(n.values()) + len(n))) for node, x in n.items()}, int(sum(n.values()))


# ---- encoding in blocks --------------------------------------------------

ENCODED = "block bigint, text_kind bigint, n_words bigint, doc_ids array<bigint>, sizes array<bigint>, n_bytes array<bigint>, ids binary, words binary, train binary"


def pack(x: np.ndarray) -> bytes:
    """Integers, in as few bytes as the largest needs (the first byte says how many), their bytes of like weight together, compressed."""
    most = max(int(x.max()), -1 - int(x.min())) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    flat = np.ascontiguousarray(x.astype(f"<i{width}")).view(np.uint8).reshape(-1, width)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.T).data)


def unpack(raw: bytes) -> np.ndarray:
    width, flat = raw[0], np.frombuffer(_plain(raw[1:]), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(f"<i{width}").astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Words without white space, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    return _plain(raw).split()


def _plain(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _encode(keys: list[int | None], texts: list[bytes], block: int, text_kind: int) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {b"": 0}  # the end token
    parts = []
    for t in texts:
        words = t.lower().split()
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        words.append(b"")
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    sizes = np.array([len(p) for p in parts])
    ids = np.concatenate(parts)
    learn = np.repeat([not held_out(k) for k in keys], sizes)
    tokens = list(numbers)
    train = np.bincount(ids[learn], minlength=len(tokens))
    as_list = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([text_kind], pa.int64()), pa.array([sum(map(len, tokens))], pa.int64())]
        + [as_list(x, pa.int64()) for x in (keys, sizes, [len(t) + 1 for t in texts])]
        + [pa.array([x], pa.binary()) for x in (pack(ids), pack_words(tokens[1:]), pack(train))],
        [x.split()[0] for x in ENCODED.split(", ")],
    )


def _encoded(cuts: dict[int, tuple[int, float]]):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, tuple[list[int | None], list[bytes], int]] = {}  # one open block a kind
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                texts = [t or b"" for t in part.column("text").to_pylist()]
                for key, text, kind in zip(part.column("doc_id").to_pylist(), texts, kinds_of(letters(texts), cuts).tolist(), strict=True):
                    keys, own, size = held.get(kind, ([], [], 0))
                    keys.append(key)
                    own.append(text)
                    held[kind] = keys, own, size + len(text)
                    if size + len(text) > BLOCK_BYTES or len(keys) >= 1 << 18:
                        yield _encode(keys, own, first + made, kind)
                        made += 1
                        del held[kind]
        for kind, (keys, own, _) in held.items():
            yield _encode(keys, own, first + made, kind)
            made += 1

    return encoded


# ---- counting ------------------------------------------------------------

#: Rows of a part: a block's counts and ranks by number, zeros at the end, of which ``words`` are the words; or, of no block, the part's sums and its words, those seen once apart.
COUNTED = "block bigint, at binary, near binary, c binary, words binary, once boolean, sums array<bigint>, rank binary, part int, n array<bigint>"


def _dealt(parts: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, train = unpack_words(batch.column("words")[k].as_py()), unpack(batch.column("train")[k].as_py())[1:]
                part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * parts >> 32  # by ranges, so that ranks don't depend on the parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                own = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                full = [p for p, x in enumerate(own) if len(x)]
                block, kind = ([batch.column(c)[k].as_py()] * len(full) for c in ("block", "text_kind"))
                columns = [pa.array(full, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int64()), pa.array([pack_words([words[i] for i in own[p]]) for p in full], pa.binary())]
                columns += [pa.array([pack(f(own[p])) for p in full], pa.binary()) for f in (lambda x: x + 1, lambda x: train[x])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "text_kind", "words", "at", "train"])

    return dealt


def _counted(kinds: list[int]):
    """The sums are, of each kind, what the words of each symbol share; then the tokens, the words, and those of them seen once.

    A word's rank is its place among the part's words of its symbol, for the block's kind, in the order of their hashes; n has how many there are.
    """

    def counted(part: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        rows, places = part.to_pylist(), []
        for row in rows:
            words = unpack_words(row["words"])
            for w in set(words).difference(numbers):
                numbers[w] = len(numbers)
            places.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        near = np.zeros((len(kinds), len(numbers)), np.int64)
        for row, at in zip(rows, places, strict=True):
            near[kinds.index(row["text_kind"]), at] += unpack(row["train"])  # a dictionary has a word once
        every, words = near.sum(axis=0), list(numbers)
        in_order = np.asarray(pc.array_sort_indices(pa.array(words, pa.binary())))
        in_order = in_order[np.argsort(np.fromiter((zlib.crc32(words[i]) for i in in_order), np.int64, len(words)), kind="stable")]
        in_order = in_order[every[in_order] > 0]
        rank, sizes = np.zeros((len(kinds), len(words)), np.int64), np.zeros((len(kinds), SYMBOLS), np.int64)
        for k, own in enumerate(near):
            symbol = known_class(own[in_order])
            alike = np.argsort(symbol, kind="stable")
            sizes[k] = np.bincount(symbol, minlength=SYMBOLS)
            rank[k, in_order[alike]] = np.arange(len(alike)) - (np.cumsum(sizes[k]) - sizes[k])[symbol[alike]]
        part_ = part.column("part")[0].as_py()
        out = []
        for row, at in zip(rows, places, strict=True):
            order = np.argsort(every[at] == 0, kind="stable")  # what training lacks comes last
            number, at, own = unpack(row["at"])[order], at[order], near[kinds.index(row["text_kind"])]
            out.append((row["block"], pack(number), pack(own[at]), pack(every[at]), pack_words([words[i] for i in at if not every[i]]), None, None, pack(rank[kinds.index(row["text_kind"]), at]), part_, None))
        mass = np.zeros((len(kinds), SYMBOLS), np.int64)
        for k, own in enumerate(near):
            np.add.at(mass[k], known_class(own), np.where(own > 0, own, every))
        out.append((None, None, None, None, None, None, [*mass.ravel().tolist(), int(every.sum()), int((every > 0).sum()), int((every == 1).sum())], None, part_, sizes.ravel().tolist()))
        for once in (True, False):
            some = np.flatnonzero(every == 1 if once else every > 1)
            out.append((None, None, None, None, pack_words([words[i] for i in some]), once, None, None, part_, None))
        kinds_ = (pa.int64(), *[pa.binary()] * 4, pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)], [x.split()[0] for x in COUNTED.split(", ")])

    return counted


# ---- spelling ------------------------------------------------------------


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, bits, word): for each bit of each word and its end byte, the slots of ORDERS contexts, the bit, and the word's row."""
    flat = np.frombuffer(b"\x00\x00\x00\x00".join([b"", *words, b""]), dtype=np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(np.concatenate(([0], sizes[:-1] + 4))) + 4
    word = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(word)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
    place = np.repeat(starts, sizes + 1) + at
    byte = flat[place].astype(np.uint64)
    context, slots = np.zeros(len(place), np.uint64), []
    bits = ((byte[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    node = np.concatenate((np.ones((len(byte), 1), np.uint64), (byte[:, None] | np.uint64(256)) >> np.arange(7, 0, -1, dtype=np.uint64)), axis=1)
    for k in range(1, ORDERS + 1):
        context = context * np.uint64(257) + flat[place - k].astype(np.uint64) + np.uint64(1)
        h = (mixed(context + np.uint64(k << 50))[:, None] ^ node * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        slots.append((h >> np.uint64(64 - SPELL_BITS)).astype(np.int32).ravel() + ((k - 1) << SPELL_BITS))
    return np.stack(slots), bits.ravel(), np.repeat(word, 8)


def _some_words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The whole words of a batch, about 64 KB at a time."""
    words, size = [], 0
    for some in batch.column("words").to_pylist():
        for w in unpack_words(some):
            words.append(w)
            size += len(w)
            if size > 1 << 16:
                yield words
                words, size = [], 0
    if words:
        yield words


def _spell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = ORDERS << SPELL_BITS
    zero, one = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for batch in batches:
        for words in _some_words(batch):
            slots, bits, _ = spelling(words)
            for k in range(ORDERS):
                np.add.at(zero, slots[k][bits == 0], 1)
                np.add.at(one, slots[k][bits == 1], 1)
    some = np.flatnonzero(zero + one)
    for at in range(0, len(some), 10_000):
        s = some[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(zero[s], pa.int64()), pa.array(one[s], pa.int64())], ["slot", "zero", "one"])


class Speller:
    """Bit predictors of the spelling tables and the gated weights that combine them."""

    def __init__(self, zero: np.ndarray, one: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.zero, self.one = zero.astype(np.float32), one.astype(np.float32)
        self.weights = np.full((GATES, ORDERS), 0.3) if weights is None else weights

    def inputs(self, slots: np.ndarray, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and the gate of each bit. bits: take these outcomes out of the counts, for words that the tables have learned."""
        zero, one = self.zero[slots], self.one[slots]
        if bits is not None:
            zero = np.maximum(zero - (bits == 0), 0)
            one = np.maximum(one - (bits == 1), 0)
        x = np.log((one + 0.4) / (zero + 0.4))
        sure = ((zero + one) > 2).sum(axis=0)  # gated by how many orders know the context
        deep = ((zero + one)[-1] > 30).astype(np.int64)
        return x, np.minimum(sure + 3 * deep, GATES - 1)

    def learn(self, words: list[bytes]) -> int:
        slots, bits, _ = spelling(words)
        x, gate = self.inputs(slots, bits)
        for at in range(0, len(bits), 1 << 13):
            part, g, y = x[:, at : at + (1 << 13)], gate[at : at + (1 << 13)], bits[at : at + (1 << 13)]
            error = y - _squash((self.weights[g].T * part).sum(axis=0))
            n = np.bincount(g, minlength=GATES)
            for k in range(ORDERS):
                self.weights[:, k] += SPELL_RATE * np.bincount(g, part[k] * error, GATES) / np.maximum(1, n) * np.minimum(100, n) / 4
        return len(bits)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each word's bytes and end."""
        out = np.zeros(len(words))
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (end == at or size + len(words[end]) < 1 << 16):
                size += len(words[end])
                end += 1
            slots, bits, word = spelling(words[at:end])
            x, gate = self.inputs(slots)
            p = np.clip(_squash((self.weights[gate].T * x).sum(axis=0)), 1e-6, 1 - 1e-6)
            out[at:end] = np.bincount(word, np.log(np.where(bits == 1, p, 1 - p)), end - at) / LOG10
            at = end
        return out


def _spell_weights(zero: np.ndarray, one: np.ndarray):
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, seen = Speller(zero, one), 0
        for batch in batches:
            for words in _some_words(batch):
                seen += speller.learn(words)
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([speller.weights.ravel().tolist()], pa.list_(pa.float64()))], ["n", "weights"])

    return learned


# ---- symbols ---------------------------------------------------------------

#: Symbols: the end, a word that training lacks, one that texts of other kinds have, and from FIRST on the logarithms of counts.
SYMBOLS, END, LACKED, ELSEWHERE, FIRST = 64, 0, 1, 2, 3
#: Bits that are no node of the tree: whether the text had a lacked word before; whether the word is the candidate.
HAD, CANDIDATE = SYMBOLS - 2, SYMBOLS - 1
NO_SYMBOL = SYMBOLS
#: Predictors of a bit, by what they know beside its node: the last symbol, the last two, how far the text is, what the
#: candidate says and how often candidates were right in a row, how frequent the text's words were so far.
CONTEXT_SIZES = (SYMBOLS, SYMBOLS * SYMBOLS, 32, 32, 64)
CONTEXTS = len(CONTEXT_SIZES)
_OFFSETS = np.cumsum((0, *CONTEXT_SIZES[:-1])) * SYMBOLS
SLOTS = SYMBOLS * sum(CONTEXT_SIZES)
WEIGHTS, RATE = (0.15, 0.2, 0.2, 0.25, 0.25), 0.006
NUMBER_WEIGHTS = (0.3, 0.2, 0.15, 0.15, 0.2)
BINS = 24


def word_class(n: np.ndarray) -> np.ndarray:
    """The symbol of a training count above 0."""
    return np.minimum(np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1 + FIRST, HAD - 1).astype(np.int64)


def known_class(near: np.ndarray) -> np.ndarray:
    """The symbol of a word that training has, by its count in the kind's texts."""
    return np.where(near > 0, word_class(near), ELSEWHERE)


class Tree:
    """The Huffman tree of the symbols that occur; mass: of each kind of text, what the words of each symbol share."""

    def __init__(self, mass: dict[int, np.ndarray], singles: int, ends: int) -> None:
        self.mass = mass
        every = sum(mass.values(), np.zeros(SYMBOLS, np.int64))
        heap = [(float(m), k, [k]) for k, m in enumerate(every) if k >= FIRST and m] + [(ends + 1.0, END, [END])]
        heap += [(singles + 1.0, k, [k]) for k in (LACKED, ELSEWHERE)]
        heapq.heapify(heap)
        paths: dict[int, list[tuple[int, int]]] = {k: [] for _, k, _ in heap}
        for node in range(len(heap) - 1):
            one, two = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in enumerate((one, two)):
                for k in side[2]:
                    paths[k].append((node, bit))
            heapq.heappush(heap, (one[0] + two[0], one[1], one[2] + two[2]))
        self.length = np.zeros(SYMBOLS, np.int64)
        self.node, self.bit = np.zeros((2, SYMBOLS, SYMBOLS), np.int64)
        #: What a symbol says of a bit: its value, or 2 where it is on no path of the symbol.
        self.says = np.full((SYMBOLS + 1, SYMBOLS), 2, np.int64)
        for k, path in paths.items():
            self.length[k] = len(path)
            for at, (node, bit) in enumerate(reversed(path)):
                self.node[k, at], self.bit[k, at], self.says[k, node] = node, bit, bit


def _back(x: np.ndarray, position: np.ndarray, k: int, start: int = 0) -> np.ndarray:
    """The value k tokens before in the text, or ``start``."""
    return np.where(position >= k, np.concatenate((np.full(k, start, x.dtype), x))[: len(x)], start)


class Block:
    """The texts of a block as bits. ids: token numbers, 0 the end; sizes: tokens of each text; counts: of each token number, in the
    training texts of the kind, and in all; mass: what the words of each symbol share.

    ``apart``: of the texts marked so, their own occurrences are left out of the counts.
    ``numbered``: bits of numbers and spellings follow; else the words of a symbol share by their counts, but for the candidate.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tree: Tree, mass: np.ndarray, apart: np.ndarray | None = None, numbered: bool = False) -> None:
        n = len(ids)
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes
        doc = self.doc = np.repeat(np.arange(len(sizes)), sizes)
        position = self.position = np.arange(n) - self.starts[doc]
        self.numbered = numbered
        seen, total = repeats(ids, doc)
        near, every = counts[0][ids], counts[1][ids]
        #: The symbol under which a word is numbered, whether or not it is left out of the counts.
        self.listed = np.where(ids == 0, END, np.where(every > 0, known_class(near), LACKED))
        if apart is not None:
            near, every = np.where(apart[doc], near - total, near), np.where(apart[doc], every - total, every)
        end = ids == 0
        symbol = self.symbol = np.where(end, END, np.where(near > 0, word_class(near), np.where(every > 0, ELSEWHERE, LACKED)))
        c = np.where(near > 0, near, every)
        # the candidate: what followed the last two words when the text had them last
        one, two = _back(ids.astype(np.int64), position, 1), _back(ids.astype(np.int64), position, 2)
        key = mixed(mixed((one << 32 | two).astype(np.uint64)) + doc.astype(np.uint64))
        key[position < 2] = np.arange(int((position < 2).sum()), dtype=np.uint64)  # no two alike
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        where = np.full(n, -1, np.int64)
        where[order[again + 1]] = order[again]
        has = where >= 0
        self.candidate = candidate = np.where(has, ids[where], 0).astype(np.int64)
        has &= candidate != 0
        self.where = np.where(has, where, -1)
        right = has & (candidate == ids)
        said = self.said = np.where(has, symbol[where], NO_SYMBOL)
        wrong = np.maximum.accumulate(np.where(right, -1, np.arange(n)))  # the last token that was no right candidate
        run = np.maximum(np.arange(n) - 1 - np.maximum(_back(wrong, position, 1, 0), self.starts[doc]), 0)
        run = self.run = np.where(position >= 1, np.minimum(run, 7), 0)
        # words that training lacks
        lacked = symbol == LACKED
        before = np.cumsum(lacked) - lacked
        self.own = before - before[self.starts][doc]  # of the text, so far
        had = lacked & (seen > 0)
        self.new = lacked & (seen == 0)
        # what the candidate has of its symbol's share
        self.share = np.where(lacked, seen, np.where(end, 1, c))
        self.whole = np.where(lacked, self.own, np.where(end, 1, mass[symbol]))
        same = (said == symbol) & ~self.new & has & (not numbered)
        held = np.zeros(n, np.int64)
        held[same] = c[where[same]]
        asks = np.flatnonzero(same & lacked)
        if len(asks):
            places = np.flatnonzero(lacked)
            known = np.sort(ids[places].astype(np.int64) << 32 | places)
            ask = candidate[asks] << 32
            held[asks] = np.searchsorted(known, ask | asks) - np.searchsorted(known, ask | self.starts[doc[asks]])
        self.rest = self.whole - held
        self.right = right
        same &= self.rest > 0  # else it is the only one left
        # the running mean of the symbols
        level = np.cumsum(symbol) - symbol
        level = (level - level[self.starts][doc] + 8 * 8) / (position + 8)
        level = np.clip(level * 3, 0, 63).astype(np.int64)
        far = np.minimum(np.log2(position + 1) * 2, 31).astype(np.int64)
        last, last2 = _back(symbol, position, 1), _back(symbol, position, 2)
        # one row a bit: the token, the node, the bit
        lengths = tree.length[symbol]
        ask_had = lacked & (self.own > 0)
        lengths_all = lengths + ask_had + same
        each = lambda x: np.repeat(x, lengths_all)
        token = each(np.arange(n))
        at = np.arange(len(token)) - each(np.cumsum(lengths_all) - lengths_all)
        path = each(symbol * SYMBOLS) + at  # beyond the path's end there is no node
        node, bit = tree.node.ravel().take(path), tree.bit.ravel().take(path)
        says = tree.says.ravel().take(each(said * SYMBOLS) + node)
        extra = np.flatnonzero(at >= each(lengths))  # the bits that are no nodes of the tree
        t = token[extra]
        is_had = ask_had[t] & (at[extra] == lengths[t])
        node[extra] = np.where(is_had, HAD, CANDIDATE)
        bit[extra] = np.where(is_had, had[t], right[t])
        says[extra] = np.where(is_had & (said[t] != LACKED), 2, 1)
        self.gate = each(1 + np.minimum(run, 6)) * (says != 2)
        slots = np.empty((CONTEXTS, len(token)), np.int64)
        for k, x in enumerate((last, last * SYMBOLS + last2, far, run, level)):
            np.add(each(_OFFSETS[k] + x * SYMBOLS), node, out=slots[k])
        slots[3] += says * (8 * SYMBOLS)
        asked = extra[~is_had]
        slots[4, asked] = _OFFSETS[4] + symbol[token[asked]] * SYMBOLS + CANDIDATE
        self.bit, self.slots, self.token, self.lengths = bit.astype(np.int8), slots, token, lengths_all

    def outcomes(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of either value by slot, of the texts marked in ``use``."""
        some = slice(None) if use.all() else np.flatnonzero(use[self.doc[self.token]])
        found = sum(np.bincount(slots[some] * 2 + self.bit[some], minlength=2 * SLOTS) for slots in self.slots)
        return found[::2], found[1::2]

    def mixed(self, stretched: np.ndarray, below: Bits = (), weights: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of each token's bits. stretched: the tables' predictions; below: bits that follow those of the symbols."""
        parts = [(self.lengths, self.bit, self.gate, stretched.take(self.slots)), *below]
        lengths = sum(p[0] for p in parts)
        sizes = np.add.reduceat(lengths, self.starts)
        rows = -(-sizes // SEGMENT)  # a text's bits fill rows of their own
        first_row, n = np.cumsum(rows) - rows, int(rows.sum()) * SEGMENT
        at = np.cumsum(lengths) - lengths
        begins = at = at + (first_row * SEGMENT - at[self.starts])[self.doc]
        bits, gates, x = np.full(n, -1, np.int8), np.zeros(n, np.int8), np.zeros((CONTEXTS, n), np.float32)
        for own, bit, gate, inputs in parts:
            place = np.repeat(at - (np.cumsum(own) - own), own) + np.arange(len(bit))
            bits[place], gates[place] = bit, gate
            for k in range(CONTEXTS):
                x[k, place] = inputs[k]
            at = at + own
        out = np.empty(n, np.float32)
        by_size = np.argsort(-rows, kind="stable")
        for low in range(0, len(by_size), MIXED_ROWS):  # texts of like size, some at a time
            some = by_size[low : low + MIXED_ROWS]
            mix(first_row[some], rows[some], *(a.reshape(*a.shape[:-1], -1, SEGMENT) for a in (bits, gates, x, out)), first_weights() if weights is None else weights)
        np.clip(out, 1e-5, 1 - 1e-5, out=out)
        out = np.where(bits == 1, out, 1 - out)
        out[bits < 0] = 1  # what fills up a text's last row
        if not n:
            return np.zeros(len(lengths))
        return np.where(lengths > 0, np.add.reduceat(np.log(out, out=out), np.minimum(begins, n - 1), dtype=np.float64), 0.0)


#: Bits of the tokens of a block: how many each has; the bits; their gates; what CONTEXTS predictors say of them, stretched, a row each.
Bits = Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def first_weights(speller: Speller | None = None) -> np.ndarray:
    """The weights that a text begins with: of the gates of symbols, of numbers, of spellings."""
    spelled = np.zeros((GATES, CONTEXTS))
    spelled[:, :ORDERS] = speller.weights if speller else 0
    return np.concatenate((np.tile(WEIGHTS, (GATES, 1)), np.tile(NUMBER_WEIGHTS, (GATES, 1)), spelled)).astype(np.float32)


def mix(first_row: np.ndarray, rows: np.ndarray, bits: np.ndarray, gates: np.ndarray, inputs: np.ndarray, out: np.ndarray, first: np.ndarray) -> None:
    """Put the probability that each bit of some texts is 1 into out. Symbols, numbers and spellings have gates and a map each.

    A text's bits are in so many rows of SEGMENT from its first one on, the texts with most rows first. What fills up the last row has no
    inputs, and nothing is read of the text after it.
    """
    m, n = len(rows), len(first)
    weights = np.tile(first.T, (1, m))
    refined = np.tile(_squash((np.arange(BINS) + 0.5 - BINS / 2) * 0.5).astype(np.float32), m * n // GATES)
    own, fewer = np.repeat(np.arange(m) * n, SEGMENT), -rows
    for at in range(int(rows[0])):
        live = int(np.searchsorted(fewer, -at))
        here = first_row[:live] + at
        x, y, g = inputs[:, here].reshape(CONTEXTS, -1), bits[here].ravel(), own[: live * SEGMENT] + gates[here].ravel()
        part = weights.take(g, axis=1)
        part *= x
        sums = part[0]
        for k in range(1, CONTEXTS):
            sums += part[k]
        np.minimum(np.maximum(sums, -20, out=sums), 20, out=sums)
        guess = np.negative(sums)
        np.exp(guess, out=guess)
        guess += 1
        np.reciprocal(guess, out=guess)
        sums *= 2
        sums += BINS / 2
        cell = np.minimum(np.maximum(sums, 0, out=sums), BINS - 1, out=sums).astype(np.int64)
        cell += (g >> 3) * BINS  # GATES a map
        now = refined.take(cell)
        out[here] = ((3 * guess + now) / 4).reshape(live, SEGMENT)
        error = np.float32(RATE) * (y - guess)
        x *= error
        for k in range(CONTEXTS):
            weights[k, : live * n] += np.bincount(g, x[k], live * n)
        cells = live * n // GATES * BINS
        tried = np.bincount(cell, minlength=cells)
        refined[:cells] += (np.bincount(cell, y - now, cells) / (tried + 50)).astype(np.float32)


class Numbers:
    """Bits of the numbers of a block's words. number: of each token number, among the words of its symbol; whole: how many words each symbol has."""

    def __init__(self, block: Block, kind: int, number: np.ndarray, whole: np.ndarray) -> None:
        ids, doc, symbol, position, n = block.ids, block.doc, block.listed, block.position, len(block.ids)
        value, size = np.where(symbol >= ELSEWHERE, number[ids], 0), np.where(symbol >= ELSEWHERE, whole[symbol], 1)
        lacked = np.flatnonzero(symbol == LACKED)
        if len(lacked):  # numbered as the text brought them
            _, first, at = np.unique(doc[lacked].astype(np.int64) << 32 | ids[lacked], return_index=True, return_inverse=True)
            new = np.zeros(n, np.int64)
            new[lacked[first]] = 1
            before = np.cumsum(new) - new
            before -= before[block.starts][doc]
            value[lacked] = before[lacked[first[at]]]
            size[lacked] = np.where(new[lacked] == 1, 1, before[lacked])
        seed = mixed((np.arange(SYMBOLS) + kind * SYMBOLS).astype(np.uint64))
        word = mixed(seed[symbol] + np.where(symbol == LACKED, 0, value).astype(np.uint64))
        one, two = _back(word, position, 1), _back(word, position, 2)
        after = (mixed(_back(symbol, position, 1, SYMBOLS).astype(np.uint64)), one, mixed(one + two * np.uint64(3)))
        other = np.where((block.where >= 0) & (symbol[block.where] == symbol), value[block.where], -1)
        # the bits of each word that training has, once; of one that it lacks, anew for each token, as the numbers follow the text
        known, lacked = np.flatnonzero(np.bincount(ids[symbol >= ELSEWHERE])), lacked[size[lacked] > 1]
        of_word = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        of_word[known] = np.arange(1, len(known) + 1)
        row = np.where(symbol >= ELSEWHERE, of_word[ids], 0)  # the first row has no bits: of ends and new words
        row[lacked] = np.arange(len(known) + 1, len(known) + 1 + len(lacked))
        token = np.zeros(len(known) + 1 + len(lacked), np.int64)
        token[row] = np.arange(n)  # one of those that a row stands for
        value, size, kind_of = (x[token].astype(np.int32) for x in (value, size, symbol))  # of one kind, fewer than 2^31 words have a symbol
        size[0] = 1
        # one place a bit, the highest first; bits that the size settles are none
        length = np.where(size > 1, np.frexp((size - 1).astype(np.float64))[1], 0).astype(np.int32)
        word_row = np.repeat(np.arange(len(size)), length)
        left = np.repeat(np.cumsum(length, dtype=np.int32), length) - np.arange(1, len(word_row) + 1, dtype=np.int32)  # bits after this one
        half = np.int32(1) << left
        over = value[word_row] >> left
        ones = size[word_row] - (over | 1) * half
        free = np.flatnonzero(ones > 0)
        word_row, left, over, half, ones = word_row[free], left[free], over[free], half[free], np.minimum(ones[free], half[free])
        length = np.bincount(word_row, minlength=len(size))
        self.row_bit, self.row_share = (over & 1).astype(np.int8), (ones / (half + ones)).astype(np.float32)
        place = (seed[kind_of][word_row] ^ ((over >> 1) << 6 | left).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        place ^= place >> np.uint64(29)
        slot = lambda h, k: ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - NUMBER_BITS)).view(np.int64) + (k << NUMBER_BITS)
        self.row_slots, self.times = slot(place, 0), np.repeat(np.bincount(row, minlength=len(size)), length)
        # one place a bit of the text
        own = self.lengths = length[row]
        each = lambda x: np.repeat(x, own)
        at = self.at = each((np.cumsum(length) - length)[row] - (np.cumsum(own) - own)) + np.arange(int(own.sum()))
        self.bit, place = self.row_bit.take(at), place.take(at)
        self.slots = [slot(place + each(x), k) for k, x in enumerate(after, 1)]
        self.gate, self.says = np.full(len(at), GATES, np.int64), np.full(len(at), -1, np.int32)
        asked = np.flatnonzero(each(other >= 0))
        guess, left, over, run = each(other)[asked], left.take(at[asked]), over.take(at[asked]), each(block.run)[asked]
        fits = np.flatnonzero(guess >> (left + 1) == over >> 1)
        asked, run = asked[fits], run[fits]
        self.gate[asked] = GATES + 1 + np.minimum(run, 6)
        self.says[asked] = (guess[fits] >> left[fits] & 1) * 8 + run

    @property
    def share(self) -> np.ndarray:
        return self.row_share.take(self.at)

    def learn(self, table: np.ndarray, use: np.ndarray) -> None:
        """Count the outcomes of the tokens in ``use`` into table, zeros and ones by slot; what candidates say comes last."""
        flat, bit, once = table.reshape(-1), self.bit.astype(np.int64), table.dtype.type(1)
        some = slice(None) if use.all() else np.flatnonzero(np.repeat(use, self.lengths))
        times = self.times if use.all() else np.bincount(self.at[some], minlength=len(self.times))
        np.add.at(flat, self.row_slots * 2 + self.row_bit, times.astype(table.dtype))
        for slots in self.slots:
            np.add.at(flat, (slots * 2 + bit)[some], once)
        says, bit = self.says[some], bit[some]
        said = np.flatnonzero(says >= 0)
        np.add.at(flat, (says[said].astype(np.int64) + (NUMBER_TABLES << NUMBER_BITS)) * 2 + bit[said], once)

    def bits(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As Bits has them. Each context leans on the one before it, the first on the share of the numbers. table: float32."""
        pairs, lean = table.reshape(-1).view(np.int64), np.float32(LEAN)

        def leant(slots: np.ndarray, p: np.ndarray) -> np.ndarray:
            found = pairs.take(slots).view(np.float32)
            total = found[::2] + found[1::2]
            total += lean
            one = p * lean
            one += found[1::2]
            one /= total
            return one

        x = np.empty((CONTEXTS, len(self.bit)), np.float32)
        leant(self.row_slots, self.row_share).take(self.at, out=x[0])
        for k, slots in enumerate(self.slots, 1):
            x[k] = leant(slots, x[k - 1])
        x[NUMBER_TABLES] = x[0]
        said = np.flatnonzero(self.says >= 0)
        found = table[self.says[said] + (NUMBER_TABLES << NUMBER_BITS)]
        x[NUMBER_TABLES, said] = (found[:, 1] + 0.4) / (found.sum(axis=1) + 0.8)
        np.clip(x, 1e-4, 1 - 1e-4, out=x)
        x /= 1 - x
        return self.lengths, self.bit, self.gate, np.log(x, out=x)


NUMBER_SLOTS = (NUMBER_TABLES << NUMBER_BITS) + 16


def spelled_bits(block: Block, words: dict[int, bytes], speller: Speller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As Bits has them, of the new words' spellings. words: by token number."""
    lengths, at = np.zeros(len(block.ids), np.int64), np.flatnonzero(block.new)
    if not len(at):
        return lengths, np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros((CONTEXTS, 0), np.float32)
    numbers, which = np.unique(block.ids[at], return_inverse=True)
    slots, bits, word = spelling([words[k] for k in numbers.tolist()])
    x, gate = speller.inputs(slots)
    sizes = np.bincount(word, minlength=len(numbers))
    own = lengths[at] = sizes[which]
    row = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    inputs = np.zeros((CONTEXTS, len(row)), np.float32)
    inputs[:ORDERS] = x[:, row]
    return lengths, bits[row], 2 * GATES + gate[row], inputs


def token_scores(block: Block, stretched: np.ndarray, spelled: np.ndarray | None = None, below: Bits = (), weights: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each token of a block: that of its bits. below: those of numbers and spellings.

    A block without numbers has shares by counts instead, and ``spelled``, of each token number, for new words.
    """
    bits = block.mixed(stretched, below, weights) / LOG10
    if block.numbered:
        return bits
    rest = np.where((block.said == block.symbol), block.rest, block.whole)
    settled = block.new | (block.symbol == END) | (block.right & (block.said == block.symbol))
    share = np.where(settled, 1.0, block.share / np.maximum(1, rest))
    return bits + np.log10(share) + np.where(block.new, spelled[block.ids], 0.0)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double"


class Vocabulary:
    """What tasks know of all words: the tree, what the words of symbols share, how many there are in each part, of each kind; parts: (part, kind by symbol)."""

    def __init__(self, tree: Tree, kinds: list[int], ends: int, parts: dict[int, np.ndarray]) -> None:
        self.tree, self.kinds, self.ends = tree, kinds, ends
        none = np.zeros((len(kinds), SYMBOLS), np.int64)
        self.before, so_far = {}, none
        for part in sorted(parts):
            self.before[part] = so_far
            so_far = so_far + parts[part]
        self.whole = so_far

    def unpacked(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, bytes]]:
        """(sizes, ids, counts, numbers, lacked words by token number) of a row of the joined blocks; counts in the kind's training texts and in all."""
        sizes, ids, k = np.asarray(row["sizes"].values), unpack(row["ids"].as_py()), self.kinds.index(row["text_kind"].as_py())
        counts, number = np.zeros((2, int(ids.max()) + 1), np.int64), np.zeros(int(ids.max()) + 1, np.int64)
        counts[:, 0] = self.ends
        words: dict[int, bytes] = {}
        for held in row["held"].as_py() or []:
            at = unpack(held["at"])
            counts[:, at] = unpack(held["near"]), unpack(held["c"])
            number[at] = unpack(held["rank"]) + self.before[held["part"]][k, known_class(counts[0, at])]
            own = unpack_words(held["words"])
            words.update(zip(at[len(at) - len(own) :].tolist(), own, strict=True))
        return sizes, ids, counts, number, words


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


#: Slots of a piece of the tables.
PIECE = 1 << 16
PIECES = "piece int, outcomes binary"


def _outcomes(all_words: Vocabulary):
    """Zeros and ones by slot, those of symbols before those of numbers, in pieces."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SLOTS + NUMBER_SLOTS, 2), np.int32)
        for row in _rows(batches):
            sizes, ids, counts, number, _ = all_words.unpacked(row)
            kind = row["text_kind"].as_py()
            use = np.array([not held_out(k) for k in row["doc_ids"].as_py()])
            ids, sizes = ids[np.repeat(use, sizes)], sizes[use]
            for a, b in _texts_at_a_time(sizes):
                tokens, every = slice(int(sizes[:a].sum()), int(sizes[:b].sum())), np.ones(b - a, bool)
                block = Block(ids[tokens], sizes[a:b], counts, all_words.tree, all_words.tree.mass[kind], every, True)
                for k, found in enumerate(block.outcomes(every)):
                    table[:SLOTS, k] += found
                Numbers(block, kind, number, all_words.whole[all_words.kinds.index(kind)]).learn(table[SLOTS:], every[block.doc])
        for k in range(0, len(table), PIECE):
            if table[k : k + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([pack(table[k : k + PIECE].ravel())], pa.binary())], ["piece", "outcomes"])

    return learned


def _summed(piece: pa.Table) -> pa.Table:
    total = sum(unpack(x.as_py()) for x in piece.column("outcomes"))
    return pa.table([pa.array([piece.column("piece")[0].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())], ["piece", "outcomes"])


def _texts_at_a_time(sizes: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` tokens, one text at least."""
    a = 0
    ends = np.cumsum(sizes)
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def score_block(kind: int, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, number: np.ndarray, words: dict[int, bytes], all_words: Vocabulary, stretched: np.ndarray, table: np.ndarray, speller: Speller, total: int, distinct: int) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base, score) of every text of a block; the score of its kind comes on top. counts: as Block has them; words: those that training lacks, by token number."""
    docs = len(sizes)
    doc = np.repeat(np.arange(docs), sizes)
    every, weights = counts[1], first_weights(speller)
    by_size = np.argsort(-sizes, kind="stable")  # long texts advance together
    own, starts = sizes[by_size], np.cumsum(sizes) - sizes
    base = np.bincount(doc, np.log10((every + 1) / (total + distinct + 1))[ids], docs)
    known = np.bincount(doc, (every > 0)[ids], docs).astype(np.int64)
    score = np.zeros(docs)
    for a, b in _texts_at_a_time(np.maximum(own, 16)):  # a text has a row at least
        some = own[a:b]
        tokens = np.repeat(starts[by_size[a:b]] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
        block = Block(ids[tokens], some, counts, all_words.tree, all_words.tree.mass[kind], numbered=True)
        below = Numbers(block, kind, number, all_words.whole[all_words.kinds.index(kind)]).bits(table), spelled_bits(block, words, speller)
        score[by_size[a:b]] = np.bincount(block.doc, token_scores(block, stretched, below=below, weights=weights), b - a)
    return sizes, known, base, score


def _scored(all_words: Vocabulary, stretched: np.ndarray, table: np.ndarray, speller: Speller, total: int, distinct: int, kind_score: dict[int, float]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, kind = row["doc_ids"].as_py(), row["text_kind"].as_py()
            n, known, base, score = score_block(kind, *all_words.unpacked(row), all_words, stretched, table, speller, total, distinct)
            score = score + kind_score[kind]
            bits = -score / math.log10(2) / np.maximum(1, np.asarray(row["n_bytes"].values))
            columns = [pa.array(keys, pa.int64()), pa.array([held_out(k) for k in keys]), pa.array(n, pa.int64()), pa.array(known, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.float64()) for v in (base, score, bits))], [x.split()[0] for x in SCORED.split(", ")])

    return scored


def stretch_tables(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Stretched predictions; a context seen rarely leans on that of its node alone."""
    node = np.tile(np.arange(SYMBOLS), SLOTS // SYMBOLS)
    p = (one[:SYMBOLS] + 0.4) / (zero[:SYMBOLS] + one[:SYMBOLS] + 0.8)
    p = np.clip((one + 2 * p[node]) / (zero + one + 2), 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p)).astype(np.float32)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs.

    A null text is an empty one: an end and nothing else. A null doc_id counts
    as the text ''. Repeated rows are scored alike, each counts in training. A very long
    text is a block of its own and scored whole. An
    empty table gives no rows; with no training text every word is spelled.
    Other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    cuts, kind_score, ends = text_kinds(own)
    blocks = stored(own.mapInArrow(_encoded(cuts), ENCODED), "encoded")
    kinds = sorted(kind_score)
    size = blocks.agg(F.sum("n_words")).first()[0]
    dealt = blocks.select("block", "text_kind", "words", "train").mapInArrow(_dealt(-(-(size or 1) // PART_BYTES)), "part int, block bigint, text_kind bigint, words binary, at binary, train binary")
    counted = stored(dealt.groupBy("part").applyInArrow(_counted(kinds), COUNTED), "counted")
    sums = counted.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))  # as many rows as kinds and symbols
    found = np.zeros(len(kinds) * SYMBOLS + 3, np.int64)
    for r in sums.collect():
        found[r["at"]] = r["n"]
    mass = dict(zip(kinds, found[:-3].reshape(len(kinds), SYMBOLS), strict=True))
    total, distinct, singles = int(found[-3]) + ends, int(found[-2]) + (ends > 0), int(found[-1])
    parts = {r["part"]: np.array(r["n"]).reshape(len(kinds), SYMBOLS) for r in counted.where("n is not null").select("part", "n").collect()}
    all_words = Vocabulary(Tree(mass, singles, ends), kinds, ends, parts)

    def tables(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed outcomes by slot: as many rows as there are slots, at most."""
        found = rows.groupBy("slot").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
        zero, one = np.zeros(n, np.int64), np.zeros(n, np.int64)
        slot = np.asarray(found.column("slot"))
        zero[slot], one[slot] = np.asarray(found.column("zero")), np.asarray(found.column("one"))
        return zero, one

    zero, one = tables(counted.where("words is not null").select("words").mapInArrow(_spell_counts, "slot int, zero bigint, one bigint"), ORDERS << SPELL_BITS)
    # words seen once stand for words never seen; each task's weights count by the bits that it learned from, and are summed by Spark
    learned = counted.where("once").select("words").mapInArrow(_spell_weights(zero, one), "n bigint, weights array<double>")
    shares = [F.sum(F.get("weights", F.lit(k)) * F.col("n")).alias(f"w{k}") for k in range(GATES * ORDERS)]
    sums = learned.agg(F.sum("n").alias("n"), *shares).first()
    weights = np.array(list(sums)[1:]).reshape(GATES, ORDERS) / sums["n"] if sums["n"] else None
    speller = Speller(zero, one, weights)

    held = counted.where("block is not null").groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("at", "near", "c", "words", "rank", "part")).alias("held"))
    met = stored(blocks.drop("words", "train", "n_words").join(held, F.col("block") == F.col("b"), "left").drop("b"), "met")
    table = np.zeros((SLOTS + NUMBER_SLOTS, 2), np.int64)
    for r in met.mapInArrow(_outcomes(all_words), PIECES).groupBy("piece").applyInArrow(_summed, PIECES).collect():  # as many as there are pieces
        piece = unpack(r["outcomes"]).reshape(-1, 2)
        table[r["piece"] * PIECE : r["piece"] * PIECE + len(piece)] = piece
    stretched, table = stretch_tables(*table[:SLOTS].T), table[SLOTS:].astype(np.float32)
    scored = met.mapInArrow(_scored(all_words, stretched, table, speller, total, distinct, kind_score), SCORED)
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_texts over all of documents."""
    return score_texts(table(spark, sf_dir, "documents"))
