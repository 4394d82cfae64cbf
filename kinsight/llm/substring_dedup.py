"""Substring dedup by repeated-phrase automata.

1. Every window of SIZE words has an anchor, the least hash of its phrases of
   PHRASE words; a document keeps its distinct anchors. Windows that are equal
   have equal anchors, so only documents with an anchor that another document
   has, too, can share a window.
2. Of those documents, the windows of such anchors are hashed and grouped: a
   window of several documents recurs, and belongs to the smallest doc_id that
   has it, its owner. Runs of an owner's windows are passages.
3. Passages are dealt to shards of bounded size. A shard's passages are compiled
   into an Aho-Corasick automaton over words: of every passage the phrases of KEY
   words at each STRIDE, one of which lies in any SIZE words of it. The parts of
   documents around their anchors are streamed through the automata of the
   shards that hold these;
   the windows around each hit are looked up word for word, and those of a
   smaller owner are the occurrences. So no hash decides what is removed; the
   owner in 2. is that of 96 bits of hash, and two windows that agree in all of
   them could leave a repeat of one in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .hashing import mixed, sliding_min, windows, word_hashes

SIZE = 50
PHRASE = 25
KEY = 25
STRIDE = SIZE - KEY + 1
#: Makes a second, independent hash of a word.
SALT = np.uint64(0xA5A3564E27F8862F)
#: Words of the passages of a shard, about; of one passage, at most.
SHARD_WORDS = 200_000
PASSAGE_WORDS = 20_000
#: Bytes of the documents' parts that meet one copy of a shard, about.
CHUNK_BYTES = 8 << 20


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of every window, as signed integers."""
    return sliding_min(windows(h, PHRASE), SIZE - PHRASE + 1).view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    sizes = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for part in _parts(batches):
        texts = _texts(part, "text")
        hashes = word_hashes(texts)
        keys = part.column("doc_id").to_pylist()
        found = [np.unique(_anchors(h)) if k is not None else np.zeros(0, np.int64) for k, h in zip(keys, hashes, strict=True)]
        digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array([len(h) for h in hashes], pa.int64()), pa.array(digests), _lists(found)],
            ["doc_id", "text_hash", "n_words", "plain_sha256", "anchors"],
        )


def _distinct_pairs(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Places of the distinct pairs."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    return order[np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))[: len(k)]]


def _windows_of_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        found, checked = [], []
        for h, own in zip(word_hashes(_texts(part, "text")), part.column("anchors"), strict=True):
            at = np.isin(_anchors(h), np.asarray(own.values))
            keys, checks = windows(h, SIZE)[at].view(np.int64), (windows(mixed(h ^ SALT), SIZE)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            first = _distinct_pairs(keys, checks)
            found.append(keys[first])
            checked.append(checks[first])
        sizes = pa.array(np.cumsum([0] + [len(k) for k in found]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(checked), pa.int32())], ["w", "c"])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(sizes, pairs)], ["doc_id", "windows"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        owners, passages, anchors = [], [], []
        texts = _texts(part, "text")
        for owner, t, h, own in zip(part.column("doc_id").to_pylist(), texts, word_hashes(texts), part.column("windows"), strict=True):
            mine = np.isin(windows(h, SIZE).view(np.int64), np.asarray(own.values))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).view(np.int8)))
            words, near = (t.split(), _anchors(h)) if len(edges) else ([], None)
            for first, last in zip(edges[::2], edges[1::2], strict=True):
                for a in range(first, last, PASSAGE_WORDS - SIZE + 1):
                    b = min(last, a + PASSAGE_WORDS - SIZE + 1)
                    owners.append(owner)
                    passages.append(b" ".join(words[a : b + SIZE - 1]))
                    anchors.append(np.unique(near[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(passages, pa.binary()), _lists(anchors)], ["owner", "passage", "anchors"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a document that a shard may know: the words of the windows of its anchors."""
    for part in _parts(batches):
        rows: list[tuple] = []
        texts = _texts(part, "text")
        keys = zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), strict=True)
        for key, t, h, routes in zip(keys, texts, word_hashes(texts), part.column("routes"), strict=True):
            words, near = t.split(), _anchors(h)
            shards, wanted = (np.asarray(routes.values.field(c)) for c in ("shard", "anchor"))
            for shard in np.unique(shards):
                at = np.isin(near, wanted[shards == shard])
                inside = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(inside, np.flatnonzero(at), 1)
                np.add.at(inside, np.flatnonzero(at) + SIZE, -1)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(inside) > 0, [False])).view(np.int8)))
                rows += [(int(shard), *key, int(a), b" ".join(words[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "text_hash", "start", "text"])


class PhraseAutomaton:
    """The automaton of a shard; words are numbered, and a number is a character of the keys.

    The passages' windows are kept with their owners, a few hundred bytes each.
    A hit of a key is confirmed by looking up the windows around it, at most
    SIZE - KEY + 1, so it costs the same however many passages have the key.
    """

    def __init__(self, owners: list[int], passages: list[bytes]) -> None:
        self.codes: dict[bytes, int] = {}
        self.windows: dict[bytes, int] = {}
        codes, windows_ = self.codes, self.windows
        self.machine = ahocorasick.Automaton()
        for owner, p in zip(owners, passages, strict=True):
            ids = np.array([codes.setdefault(w, len(codes) + 1) for w in p.split()], dtype="<u4").tobytes()
            for at in range(0, len(ids) - 4 * SIZE + 1, 4):
                window = ids[at : at + 4 * SIZE]
                windows_[window] = min(owner, windows_.get(window, owner))
            for at in range(0, len(ids) - 4 * KEY + 1, 4 * STRIDE):
                self.machine.add_word(self._text(ids[at : at + 4 * KEY]), True)
        self.machine.make_automaton()

    @staticmethod
    def _text(ids: bytes) -> str:
        return ids.decode("utf-32-le", "surrogatepass")

    def covered(self, doc_id: int, text: bytes) -> np.ndarray:
        """Which words of a text are inside a window that an owner smaller than doc_id has."""
        words = text.split()
        get, owner_of = self.codes.get, self.windows.get
        ids = np.fromiter((get(w, 0) for w in words), dtype="<u4", count=len(words)).tobytes()
        out = np.zeros(len(words), dtype=bool)
        if not self.windows or len(words) < SIZE:
            return out
        after = 0  # windows before it are looked up
        for end, _ in self.machine.iter(self._text(ids)):
            first = end - KEY + 1
            for at in range(max(after, first - (SIZE - KEY)), min(first, len(words) - SIZE) + 1):
                owner = owner_of(ids[4 * at : 4 * (at + SIZE)])
                if owner is not None and owner < doc_id:
                    out[at : at + SIZE] = True
            after = max(after, first + 1)
        return out


def _located(docs: pa.Table, shard: pa.Table) -> pa.Table:
    machine = PhraseAutomaton(shard.column("owner").to_pylist(), shard.column("passage").to_pylist()) if shard.num_rows and docs.num_rows else None
    found = []
    for key, text_hash, start, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "text_hash", "start", "text")), strict=True):
        if machine is None:
            break
        out = machine.covered(key, text)
        if out.any():
            edges = start + np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).view(np.int8)))
            found.append((key, text_hash, [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 3, kinds, strict=True)], ["doc_id", "text_hash", "spans"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        removed, kept = [], []
        for text, spans in zip(_texts(part, "text"), part.column("spans").to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words), dtype=bool)
            for s in spans:
                gone[s["a"] : s["b"]] = True
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "text_hash", "n_removed", "kept"])


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profile, changed).

    profile: doc_id, text_hash, n_words, plain_sha256 (of the words joined by
    one space), a row for each row of docs. changed: doc_id, text_hash,
    n_removed, kept (text), a row for each id and text of which words go.

    A null text has no words. A null doc_id is neither smaller nor larger than
    another: such rows keep all and own nothing. Rows that repeat an id are
    one document to each other, so nothing is removed between them. An empty
    table gives two empty ones. Other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    profile = stored(own.mapInArrow(_anchored, "doc_id bigint, text_hash bigint, n_words bigint, plain_sha256 string, anchors array<bigint>"), "anchors")
    each = profile.select("doc_id", "text_hash", F.explode("anchors").alias("anchor"))
    recurring = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = stored(each.join(recurring, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_set("anchor").alias("anchors")), "shared")
    keys = shared.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "anchors")
    held = stored(own.join(keys, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h"))).drop("d", "h"), "held")

    hashed = held.mapInArrow(_windows_of_anchors, "doc_id bigint, windows array<struct<w:bigint,c:int>>").select("doc_id", F.explode("windows").alias("x"))
    owned = hashed.groupBy("x.w", "x.c").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi")
    owned = owned.groupBy("owner").agg(F.collect_list("w").alias("windows"))
    passages = stored(
        held.drop("anchors").join(owned, F.col("doc_id") == F.col("owner")).select("doc_id", "text", "windows").mapInArrow(_passages, "owner bigint, passage binary, anchors array<bigint>"),
        "passages",
    )
    n_words = passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    shards = max(1, -(-n_words // (SHARD_WORDS * 6)))
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    # a document's parts meet the shards that hold a passage of a smaller owner with one of their anchors
    first = dealt.select("shard", "owner", F.explode("anchors").alias("anchor")).groupBy("anchor", "shard").agg(F.min("owner").alias("owner"))
    wanted = shared.select("doc_id", "text_hash", F.explode("anchors").alias("anchor")).join(first, "anchor").where("owner < doc_id")
    routes = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("shard", "anchor")).alias("routes"))
    met = held.drop("anchors").join(routes, ["doc_id", "text_hash"])
    met = stored(met.mapInArrow(_segments, "shard bigint, doc_id bigint, text_hash bigint, start int, text binary"), "segments")
    load = met.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("text")) / CHUNK_BYTES)).cast("int").alias("copies"))
    load = stored(load, "load")
    met = met.join(load, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.col("copies"))).drop("copies")
    copies = dealt.drop("anchors").join(load, "shard").select("owner", "passage", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies").cast("bigint") - 1)).alias("copy"))
    located = met.groupBy("shard", "copy").cogroup(copies.groupBy("shard", "copy")).applyInArrow(_located, "doc_id bigint, text_hash bigint, spans array<struct<a:int,b:int>>")
    spans = stored(located.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    changed = held.drop("anchors").join(spans, ["doc_id", "text_hash"]).mapInArrow(_without, "doc_id bigint, text_hash bigint, n_removed bigint, kept binary")
    changed = stored(changed.withColumn("kept", F.col("kept").cast("string")).dropDuplicates(["doc_id", "text_hash"]), "changed")
    return profile.drop("anchors"), changed


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the repeated words: texts that lose some are their other words joined by one space, all else is as it was. Columns may have any name."""
    _, changed = find_repeats(docs, doc_id, text)
    gone = changed.select(F.col("doc_id").alias("gone_d"), F.col("text_hash").alias("gone_h"), F.col("kept"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("h"))
    both = rows.join(gone, (F.col("d") == F.col("gone_d")) & (F.col("h") == F.col("gone_h")), "left")
    field = lambda c: F.col("row").getField(c)
    return both.select(*[(F.when(F.col("gone_d").isNotNull(), F.col("kept")).otherwise(field(c)) if c == text else field(c)).alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_repeats in all of documents, with the digests of what is left; it says how odd rows are taken."""
    profile, changed = find_repeats(table(spark, sf_dir, "documents"))
    gone = changed.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_removed", F.sha2("kept", 256).alias("sha"))
    both = profile.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("sha", "plain_sha256").alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)
), least_doc AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN least_doc USING (h) WHERE lo < doc_id
), w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
