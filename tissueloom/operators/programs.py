"""Operators over program tables: ranking, thresholds, gene scores, similarity, matching, enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueloom.shipping import ship


def rank_genes(scores: DataFrame, top: int | None = None) -> DataFrame:
    """(program, gene, score, rank) by score descending, ties by gene; missing scores are left out."""
    w = Window.partitionBy("program").orderBy(F.desc("score"), "gene")
    ranked = scores.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def quantile_threshold(usage: DataFrame, q: float = 0.9, mode: str = "keep") -> DataFrame:
    """Usage against the program's q-quantile: keep (>=, else 0), strict (>, else 0) or excess (max(x - q, 0))."""
    cut = usage.groupBy("program").agg(F.percentile("usage", q).alias("cut"))
    u, c = F.col("usage"), F.col("cut")
    value = {"keep": F.when(u >= c, u).otherwise(0.0), "strict": F.when(u > c, u).otherwise(0.0), "excess": F.greatest(u - c, F.lit(0.0))}[mode]
    return usage.join(F.broadcast(cut), "program").select("spot", "program", value.alias("usage"))


def normalise_rows(usage: DataFrame) -> DataFrame:
    """Usage of each spot divided by its sum; a spot of zeros stays zero."""
    total = F.sum("usage").over(Window.partitionBy("spot"))
    return usage.withColumn("usage", F.when(total != 0, F.col("usage") / total).otherwise(0.0))


def gene_scores(counts: DataFrame, usage: DataFrame) -> DataFrame:
    """(gene, program, score): coefficients of every gene's z-score on the usages, without intercept.

    The sums U'U, U'X and the gene moments come from joins on sparse rows; only the k x k system is solved
    on the driver.  Genes without variance have no score.
    """
    import numpy as np

    programs = [r[0] for r in usage.select("program").distinct().orderBy("program").collect()]  # k values
    at = {p: i for i, p in enumerate(programs)}
    pair = usage.select("spot", F.col("program").alias("p"), F.col("usage").alias("x")).join(usage.select("spot", F.col("program").alias("q"), F.col("usage").alias("y")), "spot")
    gram = np.zeros((len(at), len(at)))
    for p, q, v in pair.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y"))).collect():
        gram[at[p], at[q]] = v
    inverse = np.linalg.pinv(gram)
    spots = usage.select("spot").distinct()
    n = spots.count()
    inner = counts.join(spots, "spot", "left_semi")
    per = inner.groupBy("gene").agg((F.sum("count") / n).alias("mu"), F.sum(F.col("count") * F.col("count")).alias("q")).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - F.col("mu") * F.col("mu")))).filter("sd > 0")
    cross = inner.join(usage, "spot").groupBy("gene", "program").agg(F.sum(F.col("count") * F.col("usage")).alias("ux"))
    ones = usage.groupBy("program").agg(F.sum("usage").alias("u1"))
    full = per.join(F.broadcast(ones)).join(cross, ["gene", "program"], "left")
    uz = full.select("gene", "program", ((F.coalesce("ux", F.lit(0.0)) - F.col("u1") * F.col("mu")) / F.col("sd")).alias("uz"))
    weights = usage.sparkSession.createDataFrame([(programs[i], programs[j], float(inverse[i, j])) for i in range(len(at)) for j in range(len(at))], "target string, program string, w double")
    return uz.join(F.broadcast(weights), "program").groupBy("gene", F.col("target").alias("program")).agg(F.sum(F.col("w") * F.col("uz")).alias("score"))


def mean_rank_score(genesets: DataFrame, ranked: DataFrame) -> DataFrame:
    """(set_name, program, score): sum of 1 / rank of the set's genes in the program."""
    return genesets.join(ranked.select("program", "gene", "rank"), "gene").groupBy("set_name", "program").agg(F.sum(1.0 / F.col("rank")).alias("score"))


def rank_biased_overlap(one: DataFrame, two: DataFrame, p: float = 0.98) -> DataFrame:
    """(a, b, score): extrapolated rank-biased overlap of every list of one with every list of two that shares an item.

    Both: (name, item, rank), ranks from 1.  With p = 1 it is the average overlap down to the shorter length.
    Shared items stand at the larger of their ranks; the overlap at a depth is their running number.
    """
    la, lb = (df.groupBy("name").agg(F.max("rank").alias(n)).withColumnRenamed("name", x) for df, n, x in ((one, "n", "a"), (two, "m", "b")))
    both = one.select(F.col("name").alias("a"), "item", F.col("rank").alias("r1")).join(two.select(F.col("name").alias("b"), "item", F.col("rank").alias("r2")), "item")
    depths = both.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.greatest("r1", "r2"))).alias("at"), F.collect_list(F.struct("r1", "r2")).alias("rr"))
    rows = depths.join(la, "a").join(lb, "b")

    @F.pandas_udf("double")
    def score(at: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for depth, s, l in zip(at, np.minimum(n, m), np.maximum(n, m)):
            d = np.arange(1, l + 1)
            x = np.searchsorted(np.sort(np.asarray(depth)), d, side="right")
            if p == 1:
                out.append(float((x[:s] / d[:s]).mean()))
                continue
            head = (x / d * p**d).sum()
            tail = d[s:]
            head += (x[s - 1] * (tail - s) / (s * tail) * p**tail).sum()
            out.append(float((1 - p) / p * head + ((x[-1] - x[s - 1]) / l + x[s - 1] / s) * p**l))
        return pd.Series(out)

    return rows.select("a", "b", score("at", "n", "m").alias("score"))


def similarity(one: DataFrame, two: DataFrame, method: str = "pearson") -> DataFrame:
    """(a, b, score) of every column pair over the keys of ``two``; both: (key, name, value), missing cells are 0.

    pearson, spearman (average ranks) or cosine.  Sums over shared non-zero cells are enough for pearson and
    cosine, so zeros are never made.  A column without variance (norm for cosine) scores null (0).
    """
    keys = two.select("key").distinct()
    one = one.join(keys, "key", "left_semi")
    n = F.broadcast(keys.agg(F.count("*").alias("n")))
    if method == "spearman":
        one, two = (average_ranks(df, keys) for df in (one, two))
    a, b = (df.select("key", F.col("name").alias(x), F.col("value").alias(f"v{x}")) for df, x in ((one, "a"), (two, "b")))
    sums = lambda df, x: df.groupBy(x).agg(F.sum(f"v{x}").alias(f"s{x}"), F.sum(F.col(f"v{x}") ** 2).alias(f"q{x}"))
    cross = a.join(b, "key").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("ab"))
    full = sums(a, "a").join(F.broadcast(sums(b, "b"))).join(cross, ["a", "b"], "left").join(n)
    ab = F.coalesce("ab", F.lit(0.0))
    if method == "cosine":
        norm = F.sqrt(F.col("qa") * F.col("qb"))
        return full.select("a", "b", F.when(norm > 0, ab / norm).otherwise(0.0).alias("score"))
    cov = F.col("n") * ab - F.col("sa") * F.col("sb")
    spread = F.sqrt(F.col("n") * F.col("qa") - F.col("sa") ** 2) * F.sqrt(F.col("n") * F.col("qb") - F.col("sb") ** 2)
    return full.select("a", "b", F.when(spread > 0, cov / spread).alias("score"))


def average_ranks(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Values replaced by their average rank within the name, over all keys, missing cells being 0."""
    full = df.select("name").distinct().join(F.broadcast(keys)).join(df, ["name", "key"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    by_value = Window.partitionBy("name", "value")
    return full.select("name", "key", (F.rank().over(Window.partitionBy("name").orderBy("value")) + (F.count("*").over(by_value) - 1) / 2.0).alias("value"))


def greedy_match(scores: DataFrame) -> DataFrame:
    """(a, b, score): one-to-one pairs taken by falling score, ties by name; scores: at most k x c rows."""
    taken_a, taken_b, out = set(), set(), []
    for a, b, s in scores.orderBy(F.desc("score"), "a", "b").select("a", "b", "score").toLocalIterator():
        if s is not None and a not in taken_a and b not in taken_b:
            taken_a.add(a)
            taken_b.add(b)
            out.append((a, b, float(s)))
    return scores.sparkSession.createDataFrame(out, "a string, b string, score double")


def over_representation(genesets: DataFrame, lists: DataFrame, population: int) -> DataFrame:
    """(set_name, program, overlap, set_size, list_size, p_value, p_value_adj): hypergeometric tails, adjusted by program."""
    ship(genesets.sparkSession)
    sizes = genesets.groupBy("set_name").agg(F.count_distinct("gene").alias("set_size"))
    lengths = lists.groupBy("program").agg(F.count_distinct("gene").alias("list_size"))
    shared = genesets.select("set_name", "gene").distinct().join(lists.select("program", "gene").distinct(), "gene").groupBy("set_name", "program").agg(F.count("*").alias("overlap"))

    @F.pandas_udf("double")
    def tail(k: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        from tissueloom.functions.special import hypergeometric_tail

        return pd.Series([hypergeometric_tail(int(x), population, int(y), int(z)) for x, y, z in zip(k, s, n)])

    rows = shared.join(sizes, "set_name").join(lengths, "program").withColumn("p_value", tail("overlap", "set_size", "list_size"))
    from .counts import adjust_p_values

    return adjust_p_values(rows, by=["program"])


def pairwise_welch(values: DataFrame) -> DataFrame:
    """(one, two, t, df) of every pair of categories; values: (category, value)."""
    m = values.groupBy("category").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    a, b = (m.select(*[F.col(c).alias(f"{c}{i}") for c in m.columns]) for i in (1, 2))
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    pairs = F.broadcast(a).join(b, F.col("category1") < F.col("category2"))
    return pairs.select(F.col("category1").alias("one"), F.col("category2").alias("two"), ((F.col("mean1") - F.col("mean2")) / F.sqrt(e1 + e2)).alias("t"), ((e1 + e2) ** 2 / (e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))).alias("df"))
