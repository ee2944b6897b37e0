"""Statistical tests and descriptive statistics over categories, in joins and sums; only tail functions run on numpy."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissueloom.shipping import ship

from .programs import pairwise_welch


def _tail(name: str):
    """A pandas UDF of a function of :mod:`tissueloom.functions.special`, element by element."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        from tissueloom.functions import special

        function = getattr(special, name)
        return pd.Series([function(*map(float, row)) if all(x is not None and not math.isnan(x) for x in row) else None for row in zip(*columns)], dtype=float)

    return run


def welch_p_values(values: DataFrame) -> DataFrame:
    """(one, two, t, df, p_value): two-sided p of Welch's t for each pair of categories; values: (category, value)."""
    ship(values.sparkSession)
    return pairwise_welch(values).withColumn("p_value", _tail("t_two_sided")("t", "df"))


def mann_whitney(values: DataFrame, one: str, two: str) -> DataFrame:
    """(n1, n2, u, z, p_value) of two categories; average ranks, variance corrected for ties, no continuity correction.

    Values are first counted by (value, category), so that ranks come from sums over distinct values.
    """
    ship(values.sparkSession)
    rows = values.filter(F.col("category").isin(one, two) & F.col("value").isNotNull())
    per = rows.groupBy("value").agg(F.count("*").alias("t"), F.count_if(F.col("category") == one).alias("t1"))
    before = F.sum("t").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    ranked = per.withColumn("rank", before + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    s = ranked.agg(F.sum(F.col("t1") * F.col("rank")).alias("r1"), F.sum("t1").alias("n1"), (F.sum("t") - F.sum("t1")).alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0).withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2.0, sd))
    return out.select("n1", "n2", "u", "z", _tail("normal_two_sided")("z").alias("p_value"))


def contingency(df: DataFrame, by: list[str], one: Column, two: Column) -> DataFrame:
    """(by, a, b, c, d): rows where both hold, only the first, only the second, neither; null counts as false."""
    x, y = F.coalesce(one, F.lit(False)), F.coalesce(two, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Adds odds_ratio and p_greater, the one-sided exact p of more in ``a`` than expected; tables: (a, b, c, d)."""
    ship(tables.sparkSession)
    odds = F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return tables.withColumn("odds_ratio", odds).withColumn("p_greater", _tail("hypergeometric_tail")("a", n, F.col("a") + F.col("b"), F.col("a") + F.col("c")))


def rank_sum_markers(counts: DataFrame, types: DataFrame) -> DataFrame:
    """(gene, celltype, z): rank-sum z-score of a gene's counts in a type against all other spots, ties corrected.

    types: (spot, celltype), one row a spot.  Zeros are not stored: they share one average rank, and enter by
    their number alone.
    """
    n = types.groupBy("celltype").agg(F.count("*").alias("n1"))
    total = types.count()
    cells = counts.filter("count > 0").join(types, "spot")
    per = cells.groupBy("gene", F.col("count").alias("value")).agg(F.count("*").alias("t"))
    stored = per.groupBy("gene").agg(F.sum("t").alias("stored")).withColumn("zeros", F.lit(total) - F.col("stored"))
    before = F.sum("t").over(Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    ranks = per.withColumn("above", before).join(stored, "gene").withColumn("rank", F.col("zeros") + F.col("above") + (F.col("t") + 1) / 2.0)
    cube = lambda c: c.cast("double") * c * c - c
    ties = ranks.groupBy("gene").agg((F.sum(cube(F.col("t"))) + F.max(cube(F.col("zeros")))).alias("ties"), F.max("zeros").alias("zeros"))
    held = cells.select("gene", F.col("count").alias("value"), "celltype").join(ranks.select("gene", "value", "rank"), ["gene", "value"])
    sums = held.groupBy("gene", "celltype").agg(F.sum("rank").alias("r"), F.count("*").alias("seen"))
    full = sums.join(n, "celltype").join(ties, "gene")
    r1 = F.col("r") + (F.col("n1") - F.col("seen")) * (F.col("zeros") + 1) / 2.0
    n1, n2 = F.col("n1"), F.lit(total) - F.col("n1")
    u = r1 - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * (total + 1 - F.col("ties") / (float(total) * (total - 1))))
    return full.select("gene", "celltype", F.try_divide(u - n1 * n2 / 2.0, sd).alias("z"))


def stars(p: str) -> Column:
    """ns, *, **, *** or **** for a p-value."""
    c = F.col(p)
    return F.when(c <= 1e-4, "****").when(c <= 1e-3, "***").when(c <= 1e-2, "**").when(c <= 0.05, "*").otherwise("ns")


def nonzero_shares(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, n_share, total_share): non-zero values and sums of each group as percentages of all."""
    per = df.groupBy(by).agg(F.count_if(F.col(value) != 0).alias("n"), F.sum(value).alias("total"))
    whole = Window.partitionBy()
    return per.withColumns({"n_share": 100.0 * F.col("n") / F.sum("n").over(whole), "total_share": 100.0 * F.col("total") / F.sum("total").over(whole)})


def off_diagonal(matrix: DataFrame) -> DataFrame:
    """(a, low, mean, high) of each row's scores; matrix: (a, b, score), the diagonal counting as 0."""
    value = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("score"))
    return matrix.groupBy("a").agg(F.min(value).alias("low"), F.try_divide(F.sum(value), F.count_if(F.col("a") != F.col("b"))).alias("mean"), F.max(value).alias("high"))


def histogram_2d(df: DataFrame, x: str, y: str, wx: float, wy: float) -> DataFrame:
    """(bx, by, n, density)."""
    h = df.groupBy(F.floor(F.col(x) / wx).alias("bx"), F.floor(F.col(y) / wy).alias("by")).agg(F.count("*").alias("n"))
    return h.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy()) / (wx * wy))


def comparison_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """(greater, equal, less, alone): shares of rows with a > b, a = b, a < b, and b = 0 with a > 0."""
    x, y = F.col(a), F.col(b)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(share(x > y).alias("greater"), share(x == y).alias("equal"), share(x < y).alias("less"), share((y == 0) & (x > 0)).alias("alone"))


def trimmed(df: DataFrame, value: str, share: float = 0.99) -> DataFrame:
    """(value, n) of the smallest values that hold up to ``share`` of all rows."""
    per = df.groupBy(value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy())
    return per.withColumns({"upto": upto, "total": total}).filter(F.col("upto") <= share * F.col("total")).select(value, "n")


def errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, rmse, js): root mean square error and Jensen-Shannon distance (natural log) of columns x and y, each scaled to sum 1 for js."""
    w = Window.partitionBy(*by)
    p, q = (F.try_divide(F.col(c), F.sum(c).over(w)) for c in ("x", "y"))
    rows = pairs.withColumns({"p": p, "q": q}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / F.col("m"))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.sqrt(F.avg((F.col("x") - F.col("y")) ** 2)).alias("rmse"), F.sqrt(F.greatest(F.lit(0.0), (F.sum(part("p")) + F.sum(part("q"))) / 2)).alias("js"))


def ndcg(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, ndcg): gains x in the order of falling y, over gains in their own best order; ties by key."""
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), key))
    rows = pairs.withColumns({"i": place("y"), "j": place("x")})
    gain = lambda k: F.sum(F.col("x") / F.log2(F.col(k) + 1.0))
    return rows.groupBy(*by).agg(F.try_divide(gain("i"), gain("j")).alias("ndcg"))


def geometric_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.filter(F.col(value) > 0).groupBy(by).agg(F.exp(F.avg(F.ln(value))).alias("geometric_mean"))


def z_scores(df: DataFrame, by: str, value: str) -> Column:
    """Value less its group's mean over the group's population deviation; null without variance."""
    w = Window.partitionBy(by)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
