"""N-gram Jaccard join by chosen paths.

1. A text is the set of its shingles of SHINGLE words. Texts of equal sets are
   one node. A node's set is embedded as COORDINATES min-hash values, of which
   two sets share a part about as large as their Jaccard similarity.
2. Chosen paths: at the end of a path, one or two coordinates are sampled by
   the path's hash, alike for all nodes there, and the nodes part by their
   values of it. On average a path has 1 / SIMILARITY children, so two sets at
   the threshold keep one child in common at each level while others part.
   Paths that one node has alone end; buckets of at most BRUTE nodes are
   compared pair by pair on all coordinates. Of larger ones, those in which
   ALIKE of the nodes look similar to the least are a candidate group as they
   are, as about so many of their pairs are links; nodes of the others go on to
   the next depth, from the root and with the runs that it needs: runs(recall)
   of them bring the chance of a missed pair under the target at each depth.
3. Pairs that look similar join nodes into candidate groups. Within a group all
   pairs are verified with the whole shingle sets, in tiles of bounded size.

Only star edges and counts leave a bucket or a tile, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.operators.components import components, contracted, contracted_edges

from .common import stored, table
from .hashing import mixed, windows, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
#: Levels at which buckets are looked at; one that is large at the last is a candidate group as it is.
DEPTHS = (3, 6, 9)
#: Part of a large bucket's nodes that look similar to its least one, from which it is not split.
ALIKE = 0.5
#: Nodes of a bucket that are compared pair by pair.
BRUTE = 1000
#: Part of equal coordinates from which a pair is verified: four deviations below the threshold.
LOOK = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
RECALL = 0.999
#: Nodes of a tile of verification, in each direction.
TILE = 300

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def _lost(equal: int, depth: int, similarity: float) -> float:
    """The chance that one run parts two nodes of so many equal coordinates within ``depth`` levels."""
    more, n = 1 / similarity - 1, COORDINATES
    one = equal / n
    both, neither = one * (equal - 1) / (n - 1), (1 - one) * (n - equal - 1) / (n - 1)
    lost = 0.0
    for _ in range(depth):
        two = neither + (1 - both - neither) * lost + both * lost * lost
        lost = (1 - more) * (1 - one + one * lost) + more * two
    return lost


def runs(recall: float = RECALL, similarity: float = SIMILARITY, depth: int = DEPTHS[0]) -> int:
    """Runs after which a pair at the threshold has met in a bucket of ``depth`` with probability ``recall``, over the coordinates that it may have equal.

    All pairs share the paths of a run, so half of the misses are kept back for their luck.
    """
    share = [math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    lost = [_lost(k, depth, similarity) if k >= LOOK * COORDINATES else 1.0 for k in range(COORDINATES + 1)]
    for n in range(1, 1000):
        if sum(s * x**n for s, x in zip(share, lost, strict=True)) <= (1 - recall) / 2:
            return n
    raise ValueError(f"{COORDINATES} coordinates can't reach a recall of {recall}")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words are one shingle where there are fewer than SHINGLE."""
    out = []
    for h in word_hashes(texts):
        out.append(np.unique(windows(h, SHINGLE if len(h) >= SHINGLE else max(1, len(h)))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each of COORDINATES permutations over each set: uint32, a row for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * _FACTORS[k], starts) >> np.uint64(32)
    return out


def children(paths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path): the children of each path, given the signature of its node in the same row."""
    first = (mixed(paths + np.uint64(1)) % np.uint64(COORDINATES)).astype(np.int64)
    second = ((mixed(paths + np.uint64(2)) % np.uint64(COORDINATES - 1)).astype(np.int64) + first + 1) % COORDINATES
    both = np.flatnonzero(mixed(paths + np.uint64(3)) < np.uint64(int((1 / SIMILARITY - 1) * 2.0**64)))
    rows = np.concatenate((np.arange(len(paths)), both))
    chosen = np.concatenate((first, second[both]))
    token = values[rows, chosen].astype(np.uint64) * np.uint64(COORDINATES) + chosen.astype(np.uint64)
    return rows, mixed(paths[rows] * _GOLD + mixed(token))


def _signature_column(batch: pa.RecordBatch, name: str = "signature") -> np.ndarray:
    raw = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(raw, dtype="<u4").reshape(-1, COORDINATES)


def _embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            part = whole.slice(at, 1000)
            sets = shingle_sets([t or b"" for t in part.column("text").to_pylist()])
            full = [s for s in sets if len(s)]
            made = iter(signatures(full) if full else [])
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            marks = [next(made).astype("<u4").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary())], ["doc_id", "text_hash", "node", "signature"]
            )


def _paths(depth: int, n_runs: int):
    """The paths of each node, ``depth`` levels on, of so many runs."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                nodes, values = np.asarray(batch.column("node")), _signature_column(batch)
                rows = np.tile(np.arange(len(nodes)), n_runs)
                paths = np.repeat(mixed(np.arange(1, n_runs + 1, dtype=np.uint64) * _GOLD), len(nodes))
                for _ in range(depth):
                    at, paths = children(paths, values[rows])
                    rows = rows[at]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows], pa.int64()), pa.array(paths.view(np.int64), pa.int64())], ["node", "path"])

    return grown


def _bucket_edges(nodes: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Star edges of the groups that the similar pairs of a bucket (nodes ascending) form."""
    u, v = [], []
    for i in range(len(nodes) - 1):
        alike = np.flatnonzero((values[i + 1 :] == values[i]).sum(axis=1) >= LOOK * COORDINATES)
        u.append(alike + i + 1)
        v.append(np.full(len(alike), i))
    u, v = contracted(np.concatenate(u), np.concatenate(v))
    return list(zip(nodes[u].tolist(), nodes[v].tolist(), strict=True))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by path; the last path of a batch may go on in the next."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    seen: set[bytes] = set()

    def edges(paths: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate(([True], paths[1:] != paths[:-1], [True])))
        found: set[tuple[int, int]] = set()
        sizes = np.diff(cuts)
        pairs = cuts[:-1][sizes == 2]
        alike = (values[pairs] == values[pairs + 1]).sum(axis=1) >= LOOK * COORDINATES
        found.update(zip(nodes[pairs[alike] + 1].tolist(), nodes[pairs[alike]].tolist(), strict=True))
        for a, b in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2], strict=True):
            order = np.argsort(nodes[a:b])
            own = nodes[a:b][order]
            key = xxhash.xxh3_128_digest(own.tobytes())
            if key in seen:  # the same nodes met on another path
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(key)
            found.update(_bucket_edges(own, values[a:b][order]))
        u, v = zip(*found, strict=True) if found else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.asarray(batch.column("path")), np.asarray(batch.column("node")), _signature_column(batch)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = tuple(x[cut:] for x in now)
        if cut:
            yield edges(*(x[:cut] for x in now))
    if held is not None:
        yield edges(*held)


def candidate_edges(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Star edges (u, v) of nodes (node, signature) that may be similar.

    Each level loses pairs, so nodes of a bucket that is split get as many runs
    as the next depth needs; a pair that shares such a bucket has both there.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges, at = None, nodes
    for depth in DEPTHS:
        rows = stored(at.mapInArrow(_paths(depth, runs(recall, depth=depth)), "node bigint, path bigint"), "paths")
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(rows.join(counts, "path").join(at, "node"), "buckets")
        small = shared.where(F.col("n") <= BRUTE).select("path", "node", "signature").repartition(parts, "path").sortWithinPartitions("path")
        found = stored(small.mapInArrow(lambda rows: contracted_edges(_compared(rows)), "u bigint, v bigint"), "edges")
        edges = found if edges is None else edges.unionByName(found)
        large = shared.where(F.col("n") > BRUTE)
        if large.isEmpty():
            return edges
        heads = large.groupBy("path").agg(F.min(F.struct("node", "signature")).alias("head"))
        same = lambda k: F.substring("signature", 4 * k + 1, 4) == F.substring("head.signature", 4 * k + 1, 4)
        near = sum((same(k).cast("int") for k in range(COORDINATES)), F.lit(0)) >= LOOK * COORDINATES
        hung = stored(large.join(heads, "path").select("path", F.col("node").alias("u"), F.col("head.node").alias("v"), near.alias("near")), "hung")
        split = hung.groupBy("path").agg(F.avg(F.col("near").cast("int")).alias("part")).where(F.col("part") < (ALIKE if depth < DEPTHS[-1] else 0)).select("path")
        edges = edges.unionByName(hung.join(split, "path", "left_anti").select("u", "v"))
        at = stored(at.join(hung.join(split, "path", "left_semi").select(F.col("u").alias("node")).distinct(), "node", "left_semi"), "again")
        if at.isEmpty():
            return edges
    return edges


def _verified(group: pa.Table) -> pa.Table:
    """Links of a tile's nodes: all pairs of the one block, or those between the two."""
    group = group.combine_chunks()
    nodes, blocks, copies = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "block", "copies"))
    order = np.argsort(nodes, kind="stable")
    nodes, blocks, copies = nodes[order], blocks[order], copies[order]
    texts = group.column("text").to_pylist()
    sets = shingle_sets([texts[i] for i in order])
    n, sizes = len(nodes), np.array([len(s) for s in sets], dtype=np.int64)
    flat, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    at = np.argsort(flat, kind="stable")
    flat, rows = flat[at], rows[at]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(fresh) - 1
    often = np.bincount(number)[number] > 1  # only shingles that two nodes have
    rows, number = rows[often], np.unique(number[often], return_inverse=True)[1] if often.any() else number[:0]
    common = np.zeros((n, n), dtype=np.float64)
    step = max(1, min(8192, (1 << 22) // max(1, n)))
    bounds = np.searchsorted(number, np.arange(0, int(number[-1]) + 1 + step, step)) if len(number) else np.zeros(1, int)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        one = np.zeros((n, step), dtype=np.float32)
        one[rows[a:b], number[a:b] - k * step] = 1
        common += one @ one.T
    linked = common >= SIMILARITY * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if len(set(blocks.tolist())) > 1 or group.column("across")[0].as_py():
        linked &= blocks[:, None] != blocks[None, :]
    roots = nodes.copy()
    u, v = contracted(*np.nonzero(linked))
    roots[u] = nodes[v]
    return pa.Table.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array(linked.sum(axis=1), pa.int64()), pa.array((linked * copies[None, :]).sum(axis=1), pa.int64())],
        ["node", "root", "n_texts", "n_docs"],
    )


def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, class_id, class_node, n_links, n_text_links.

    class_id is the least doc_id of the documents that links connect; n_links
    counts the other documents whose shingle sets have a Jaccard similarity of
    SIMILARITY or more with this one's, n_text_links the different sets among
    them; class_node tells classes apart where ids do not. A text without words
    has no links, is its own class and has no class_node; null ids count as
    documents, and name no class unless all of it is null. Rows that
    repeat are copies of each other. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("binary").alias("text"))
    marked = stored(own.mapInArrow(_embedded, "doc_id bigint, text_hash bigint, node bigint, signature binary"), "signatures")
    nodes = marked.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash", "signature")).alias("one")
    )
    nodes = stored(nodes.select("node", "copies", "first", "one.doc_id", "one.text_hash", "one.signature"), "nodes")
    groups = stored(components(candidate_edges(nodes.select("node", "signature"), recall)), "groups")

    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes.select("node", "copies", "doc_id", "text_hash"), "node")
    wanted = placed.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "node", "component", "blocks", "block", "copies")
    # one row stands for a node's copies: by its id, so no text's copies meet
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).drop("doc_id", "text_hash", "d", "h")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    tiles = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(
        "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "block", "copies", "text"
    ).withColumn("across", F.col("x") != F.col("y"))
    links = tiles.groupBy("component", "x", "y").applyInArrow(_verified, "node bigint, root bigint, n_texts bigint, n_docs bigint")
    links = stored(links, "links")
    classes = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sums = links.where("n_texts > 0").groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    linked = sums.join(classes, "node").join(nodes.select("node", "first"), "node")
    # stored, as is what is joined next: a node is in it once
    linked = stored(linked, "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("class_id"))
    linked = linked.join(least, "component").select(F.col("node").alias("l"), F.col("component").alias("class"), "class_id", "n_texts", "n_docs")
    known = nodes.select(F.col("node").alias("k"), "copies", "first").join(linked, F.col("k") == F.col("l"), "left").select(
        "k",
        F.coalesce("class", "k").alias("class"),
        F.when(F.col("l").isNull(), F.col("first")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("n_texts", F.lit(0)).alias("texts"),
    )
    return marked.select("doc_id", "text_hash", "node").join(known, F.col("node") == F.col("k"), "left").select(
        F.col("doc_id").alias(doc_id),
        "text_hash",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.col("class").alias("class_node"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_text_links"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_similar of all of documents; it says how odd rows are taken."""
    return join_similar(table(spark, sf_dir, "documents")).drop("text_hash", "class_node")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS class_id,
       (SELECT count(*) FROM pairs WHERE a = d.doc_id) AS n_links,
       (SELECT count(DISTINCT y.h) FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE p.a = d.doc_id AND x.h <> y.h) AS n_text_links
FROM documents d
"""
