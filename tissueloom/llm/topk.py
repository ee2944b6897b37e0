"""Exact top-k by integer inner product with multi-resolution segment statistics.

A vector is cut into segments; the mean and the deviation of each are kept for several segment counts.  With
m and s those of a segment of length l, sum(a * b) <= l * (ma * mb + sa * sb), so the distance of two
vectors is at least sqrt(sum l * ((ma - mb)^2 + (sa - sb)^2)) and their inner product at most the sum of the
bounds.  Candidates are bounded coarse to fine against each query's k-th best so far, and only survivors get
their exact score; the first rows that a task meets come in few, so that there is a k-th best early.  Queries are taken in blocks of bounded size, each block against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

SCALE = 1024
SEGMENTS = (4, 16, 32)
#: The first rows of a task only set the queries' floors, so they come in few.
FIRST_ROWS, MOST_ROWS = 64, 1024
QUERY_BLOCK = 4096
EXACT = float(1 << 53)


def segment_statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of ``parts`` segments, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        seg = x[:, a:b]
        out += [seg.mean(1) * np.sqrt(b - a), seg.std(1) * np.sqrt(b - a)]
    return np.stack(out, 1) if out else np.zeros((len(x), 0))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and x; whole in 64-bit floats where sizes allow, else by Python integers."""
    reach = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if reach < EXACT:
        return q @ x.T
    return np.array(q.astype(object).dot(x.astype(object).T))


class Search:
    """Keeps the k best of each query while rows stream by."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, segments=SEGMENTS):
        self.ids, self.q, self.k, self.segments = ids, queries, k, segments
        self.stats = [segment_statistics(queries, s) for s in segments]
        self.floor = np.full(len(ids), -np.inf)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.exact = self.seen = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            step = min(MOST_ROWS, max(FIRST_ROWS, self.seen))
            self._add(ids[at : at + step], x[at : at + step])
            self.seen += step
            at += step

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        live = np.ones((len(self.ids), len(ids)), bool)
        for s, q_stats in zip(self.segments, self.stats):
            x_stats = segment_statistics(x, s)
            slack = 1e-9 * (np.abs(q_stats).sum(1)[:, None] * np.abs(x_stats).max(initial=0) + 1)
            if live.mean() > 0.1:
                live &= q_stats @ x_stats.T + slack >= self.floor[:, None]
            else:
                i, j = np.nonzero(live)
                out = np.einsum("ij,ij->i", q_stats[i], x_stats[j]) + slack[i, 0] < self.floor[i]
                live[i[out], j[out]] = False
        self.exact += int(live.sum())
        for r in np.flatnonzero(live.any(1)).tolist():
            cols = np.flatnonzero(live[r])
            row = exact_scores(self.q[r : r + 1], x[cols])[0]
            at = np.flatnonzero(row >= self.floor[r])
            own = ids[cols[at]]
            pick = own != self.ids[r]
            got = [(-int(s), int(i)) for s, i in zip(row[at[pick]].tolist(), own[pick].tolist())]
            self.best[r] = sorted(self.best[r] + got)[: self.k]
            if len(self.best[r]) == self.k:
                self.floor[r] = float(-self.best[r][-1][0]) * (1 - 1e-15 * np.sign(-self.best[r][-1][0]))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): components floor(scale * x) as doubles; rows with a null id, null vectors, or null or non-finite components are left out."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrices(ids: np.ndarray, lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each vector length met."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :]
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield ids[at], flat[starts[at][:, None] + np.arange(n)]


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Candidates are all rows but those with the query's own id; repeated ids are one candidate each row.
    Vectors of another length than the query's are no candidates, and a score beyond 64 bits raises.  ``is_query`` is a condition on ``id``.
    Queries come to the driver ``QUERY_BLOCK`` at a time; each block goes over all rows, a running best list
    a task, and the lists are merged.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    asked = rows.filter(is_query)
    found, block = None, []

    def search(block: list) -> DataFrame:
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r["v"]), []).append(r)
        packed = {n: (np.array([r["id"] for r in rs], np.int64), np.array([r["v"] for r in rs], float).reshape(len(rs), n)) for n, rs in by_size.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = {n: Search(i, q, k) for n, (i, q) in packed.items()}
            for batch in batches:
                for ids, x in _matrices(batch.column(0).to_numpy(), batch.column(1)):
                    if x.shape[1] in searches:
                        searches[x.shape[1]].add(ids, x)
            for s in searches.values():
                out = [(q, i, -score) for q, best in zip(s.ids.tolist(), s.best) for score, i in best]
                if out:
                    q, i, score = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        return map_arrow(rows, run, "query_id long, vec_id long, score long")

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found = search(block) if found is None else found.union(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.union(search(block))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
