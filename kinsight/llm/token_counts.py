"""Token counts by a linear longest-match automaton.

Greedy word pieces (the longest piece of the vocabulary at each place) are
counted without being built. The vocabulary is a trie whose nodes have a
failure link and the number of pieces that are popped on following it; a word
is read once from left to right, and each step either goes down the trie or
pops. Words are counted once for each batch of texts and remembered.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Ends a word in the vocabulary.
WORD_END = "</w>"
#: Words that a Python worker remembers; all are forgotten when full.
REMEMBERED = 400_000

_automata: dict[tuple[str, ...], "LongestMatch"] = {}


class LongestMatch:
    """Trie, failure links and popped-piece counts.

    ``goto[v]`` maps a character to a child. ``link[v]`` is where matching goes
    on when v has no child for the next character: the node of what is left of
    v's text once the longest pieces, ``pops[v]`` in number, are taken off its
    front; -1 if no piece can be taken.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        piece = [False]
        for p in pieces:
            v = 0
            for c in p:
                v = self.goto[v].get(c) or self._child(v, c, piece)
            piece[v] = v != 0
        self.link, self.pops = [-1] * len(piece), [0] * len(piece)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.goto[u].items():
                queue.append(v)
                if piece[v]:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                at, popped = self.link[u], self.pops[u]
                while at >= 0 and c not in self.goto[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[v], self.pops[v] = self.goto[at][c], popped

    def _child(self, v: int, c: str, piece: list[bool]) -> int:
        self.goto.append({})
        piece.append(False)
        self.goto[v][c] = len(piece) - 1
        return len(piece) - 1

    def count(self, word: str) -> int:
        """The number of pieces of a word, -1 if some part of it is no piece."""
        at, popped, goto, link, pops = 0, 0, self.goto, self.link, self.pops
        for c in word:
            while c not in goto[at]:
                popped += pops[at]
                at = link[at]
                if at < 0:
                    return -1
            at = goto[at][c]
        while at:
            popped += pops[at]
            at = link[at]
            if at < 0:
                return -1
        return popped


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_pieces(path: str) -> list[str]:
    """Pieces of a vocabulary file of the tokenizers library, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held.get("added_tokens", [])}
    return sorted(set(held["model"]["vocab"]) - special)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row of docs.

    Words are white-space separated, A-Z lower-cased, spelled in byte
    characters and closed by WORD_END. A word that greedy matching cannot spell
    is one token and unknown. A null or empty text has none; repeated rows and
    null ids count as any others; an empty table gives no rows; other columns
    are not read. The vocabulary is a file beside the library, of a fixed size.
    """
    table_ = byte_characters()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary,) not in _automata:
            _automata[(vocabulary,)] = LongestMatch(load_pieces(vocabulary))
        machine, known = _automata[(vocabulary,)], {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                split = [(t or b"").lower().split() for t in part.column("text").to_pylist()]
                fresh = {w for words in split for w in words if w not in known}
                if len(known) + len(fresh) > REMEMBERED:
                    known = {}
                    fresh = {w for words in split for w in words}
                for w in fresh:
                    known[w] = machine.count("".join(map(table_.__getitem__, w)) + WORD_END)
                lengths = [[known[w] for w in words] for words in split]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in lengths], pa.int64()),
                        pa.array([sum(abs(k) for k in x) for x in lengths], pa.int64()),
                        pa.array([x.count(-1) for x in lengths], pa.int64()),
                    ],
                    ["doc_id", "n_words", "n_tokens", "n_unknown"],
                )

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(counted, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all of documents; the operator above says how odd rows are taken."""
    from .best_fit import vocabulary_path

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
