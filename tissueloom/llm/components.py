"""Connected components of an edge table: spanning forests within tasks, then one task or alternating stars.

Each task leaves only a spanning forest of its edges, without a shuffle.  Up to ``LOCAL_EDGES`` edges of those, one task
ends the work; so a small table takes two short stages, however many partitions a shuffle has, and the driver plans
and keeps no rounds of it.  More edges go through large and small stars: every step is a map-side combined minimum and
a join (which Spark splits when skewed), and each round is written to the shared folder; nothing is gathered on the
driver but a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: So many edges (16 bytes each) one task takes.
LOCAL_EDGES = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges, root the smallest node reachable; the nodes are sorted."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        live = a != b
        a, b = a[live], b[live]
    return nodes, nodes[root]


def _forests(edges: DataFrame, most: int, with_roots: bool) -> DataFrame:
    """(u, v): each node of a task's edges and its root there; begun anew where a task has more than ``most``."""

    def run(batches):
        held, n = [], 0

        def flush(last: bool):
            nonlocal held, n
            node, root = forest(*(np.concatenate(x) for x in zip(*held)))
            inner = node != root
            n = int(inner.sum())
            if last or n > most // 2:
                at = slice(None) if with_roots else inner
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(root[at])], names=["u", "v"])
                held, n = [], 0
            else:
                held = [(node[inner], root[inner])]

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n > most and not with_roots:
                yield from flush(False)
        if n:
            yield from flush(True)

    return map_arrow(edges, run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct.  Each node's kept neighbours move to its smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable; written.  Loops and repeats are fine."""
    now = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v")
    now = materialize(_forests(now, LOCAL_EDGES, with_roots=False), "edges")
    if now.count() <= LOCAL_EDGES:
        return materialize(_forests(now.coalesce(1), LOCAL_EDGES, with_roots=True), "roots").select(F.col("u").alias("node"), F.col("v").alias("root"))
    now = materialize(now.distinct(), "edges")
    state = None
    while True:
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialize(roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
