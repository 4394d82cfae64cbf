"""Connected components of an edge list, without collecting any group.

A round contracts edges within tasks, then across them:

1. the edges, dealt by their larger node, are contracted in each task: every
   node hangs on the least node that it is connected with there;
2. a node that hangs on several keeps the least; the others are linked with it;
3. each node moves on to the node that its own one hangs on.

The first contraction is done before any shuffle, so a node sends one row a task
at most and a hub is no hot key. All else is a combinable aggregation or an
equi-join, which adaptive execution splits. The number of rounds grows with the
logarithm of the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.storage import stored

#: Beyond so many rounds the input is taken to be broken, and an error raised; a chain of n nodes takes about log2(n).
MOST_ROUNDS = 50
#: Edges that a task contracts at a time, about.
CHUNK = 1 << 21


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node but the roots: the least node that the edges connect it with."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        high, low = np.maximum(up[a], up[b]), np.minimum(up[a], up[b])
        open_ = high != low
        if not open_.any():
            break
        np.minimum.at(up, high[open_], low[open_])
        while (further := up[up]).tobytes() != up.tobytes():
            up = further
    some = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[some], nodes[up[some]]


def contracted_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract a task's edges (u, v); what is left is held and met by the next ones."""
    u, v, size = [], [], 0

    def held() -> None:
        nonlocal u, v, size
        a, b = contracted(np.concatenate(u), np.concatenate(v))
        u, v, size = [a], [b], 0

    for batch in batches:
        u.append(np.asarray(batch.column("u")))
        v.append(np.asarray(batch.column("v")))
        size += batch.num_rows
        if size > max(CHUNK, len(u[0])):
            held()
    if u:
        held()
        for at in range(0, len(u[0]), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(u[0][part], pa.int64()), pa.array(v[0][part], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: bigint); a component is named by its least node.

    Rows with a null end or two equal ends connect nothing; repeated rows are one.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = edges.select("u", "v").where("u <> v").mapInArrow(contracted_edges, "u bigint, v bigint")
    for _ in range(MOST_ROUNDS):
        hung = now.repartition(parts, "u").mapInArrow(contracted_edges, "u bigint, v bigint")
        # a node hangs on one node a task at most, so the set is bounded by the number of tasks
        hung = stored(hung.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("all")), "hung")
        moved = hung.select("u", "m").join(hung.select(F.col("u").alias("m"), F.col("m").alias("on")), "m", "left")
        moved = moved.select("u", F.coalesce("on", "m").alias("v"), F.col("on").isNotNull().alias("open"))
        linked = hung.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.col("m").alias("v")).where("u <> v").withColumn("open", F.lit(True))
        now = stored(moved.unionByName(linked), "moved")
        if now.where("open").isEmpty():
            break
        now = now.drop("open")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
