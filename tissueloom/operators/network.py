"""Program co-occurrence networks: pair statistics, edges, prevalence, communities, group connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_stats(usage: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(one, two, n, pos, neg, val) for ordered pairs of active programs, self pairs included.

    n: spots where one is active; pos: of these, where two is as well; val: (pos + 1) / (n + 2).  Only active
    cells are joined, on the spot.
    """
    active = usage.filter(F.col("usage") > threshold).select("spot", "program")
    n = active.groupBy(F.col("program").alias("one")).agg(F.count("*").alias("n"))
    pos = active.select("spot", F.col("program").alias("one")).join(active.select("spot", F.col("program").alias("two")), "spot").groupBy("one", "two").agg(F.count("*").alias("pos"))
    every = F.broadcast(n).join(n.select(F.col("one").alias("two")))
    full = every.join(pos, ["one", "two"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)).cast("long"))
    return full.select("one", "two", "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), ((F.col("pos") + 1) / (F.col("n") + 2)).alias("val"))


def edges(stats: DataFrame, n_bins: int = 100, edge_threshold: float = 0.199) -> DataFrame:
    """(source, target, weight): pairs with |val| above the threshold, enough spots, no loops."""
    return stats.filter((F.abs("val") > edge_threshold) & (F.col("n") >= n_bins) & (F.col("one") != F.col("two"))).select(F.col("one").alias("source"), F.col("two").alias("target"), F.col("val").alias("weight"))


def node_attributes(usage: DataFrame, threshold: float = 0.0, prevalence: int = 100) -> DataFrame:
    """(program, cpp, proportion, is_prevalent): spots where the program is active."""
    total = usage.agg(F.count_distinct("spot").alias("total"))
    per = usage.groupBy("program").agg(F.count_if(F.col("usage") > threshold).alias("cpp"))
    return per.join(F.broadcast(total)).select("program", "cpp", (F.col("cpp") / F.col("total")).alias("proportion"), (F.col("cpp") >= prevalence).alias("is_prevalent"))


def group_connections(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(program, cluster, n_in, n_out): distinct links of each program from and to programs of each cluster."""
    of = clusters.select(F.col("program").alias("other"), "cluster")
    out = links.select(F.col("source").alias("program"), F.col("target").alias("other")).distinct().join(of, "other").groupBy("program", "cluster").agg(F.count("*").alias("n_out"))
    into = links.select(F.col("target").alias("program"), F.col("source").alias("other")).distinct().join(of, "other").groupBy("program", "cluster").agg(F.count("*").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return into.join(out, ["program", "cluster"], "full").select("program", "cluster", zero("n_in"), zero("n_out"))


def connection_matrix(links: DataFrame, clusters: DataFrame, order: list[int]) -> DataFrame:
    """One row a program of ``clusters`` with in_Cluster<c> and out_Cluster<c>: log2(1 + links), 0 where there is none."""
    found = group_connections(links, clusters)
    cell = lambda n, c: F.log2(1.0 + F.coalesce(F.max(F.when(F.col("cluster") == c, F.col(n))), F.lit(0)))
    every = clusters.select("program").distinct().join(found, "program", "left")
    return every.groupBy("program").agg(*[cell(n, c).alias(f"{way}_Cluster{c}") for c in order for way, n in (("in", "n_in"), ("out", "n_out"))])


def edge_flags(links: DataFrame, thresholds: tuple[float, ...] = (0.099, 0.199, 0.299, 0.399, 0.499)) -> DataFrame:
    """(source, target, gt1 .. gt5): whether the weight is above each threshold."""
    return links.select("source", "target", *[(F.abs("weight") > t).alias(f"gt{i}") for i, t in enumerate(thresholds, 1)])


def network(usage: DataFrame, threshold: float = 0.0, n_bins: int = 100, edge_threshold: float = 0.199, prevalence: int = 100) -> dict[str, DataFrame]:
    """All tables of a network by name: pairs, edges, flags, nodes, clusters and connections."""
    pairs = pair_stats(usage, threshold)
    links = edges(pairs, n_bins, edge_threshold)
    clusters = communities(links, usage)
    numbers = sorted(r[0] for r in clusters.select("cluster").distinct().collect())  # at most one a program
    return {"pairs": pairs, "edges": links, "flags": edge_flags(links), "nodes": node_attributes(usage, threshold, prevalence), "clusters": clusters, "connections": connection_matrix(links, clusters, numbers)}


def communities(links: DataFrame, nodes: DataFrame, trials: int = 10, seed: int = 42) -> DataFrame:
    """(program, cluster): flow communities by the map equation; programs without links get -1.

    Links are at most k x k rows of one network and are handled on the driver.
    """
    import numpy as np

    rows = [(r[0], r[1], float(r[2])) for r in links.select("source", "target", "weight").orderBy("source", "target").toLocalIterator()]
    names = sorted({x for r in rows for x in r[:2]})
    at = {p: i for i, p in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, v in rows:
        w[at[a], at[b]] += v
    label = _map_equation(w, trials, seed) if names else []
    found = {p: int(c) for p, c in zip(names, label)}
    every = [r[0] for r in nodes.select("program").distinct().orderBy("program").toLocalIterator()]
    return links.sparkSession.createDataFrame([(p, found.get(p, -1)) for p in every], "program string, cluster int")


def _map_equation(w, trials: int, seed: int):
    import numpy as np

    n = len(w)
    out = w.sum(1, keepdims=True)
    step = np.where(out > 0, w / np.where(out > 0, out, 1), 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(500):
        new = 0.85 * rank @ step + 0.15 / n
        if np.abs(new - rank).sum() < 1e-14:
            break
        rank = new
    flow = rank[:, None] * step
    flow /= flow.sum()
    visit = flow.sum(0)

    def plogp(x):
        x = np.asarray(x, float)
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0.0).sum()

    def length(label) -> float:
        member = label[:, None] == np.unique(label)[None, :]
        leave = np.array([flow[np.ix_(m, ~m)].sum() for m in member.T])
        return plogp(leave.sum()) - 2 * plogp(leave) - plogp(visit) + plogp(leave + member.T @ visit)

    best, best_length = np.zeros(n, int), length(np.zeros(n, int))
    draw = np.random.default_rng(seed)
    for _ in range(trials):
        label = np.arange(n)
        now, moved = length(label), True
        while moved:
            moved = False
            for i in draw.permutation(n):
                old = label[i]
                choices = []
                for c in np.unique(label[(flow[i] + flow[:, i]) > 0]):
                    label[i] = c
                    choices.append((length(label), int(c)))
                label[i] = old
                if choices and min(choices)[0] < now - 1e-12:
                    now, label[i] = min(choices)
                    moved = True
        if now < best_length - 1e-12:
            best, best_length = label.copy(), now
    return np.unique(best, return_inverse=True)[1]
