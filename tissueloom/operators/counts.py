"""Operators over sparse counts (spot, gene, count): filters, moments, normalisation, over-dispersion.

Zeros are not stored, so every mean and variance divides by the number of spots, given or counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissueloom.shipping import ship


def filter_spots(counts: DataFrame, min_counts: float = 1, min_genes: int = 1) -> DataFrame:
    """Spots with enough counts and detected genes; one shuffle by spot for both."""
    good = counts.groupBy("spot").agg(F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("genes"))
    return counts.join(good.filter((F.col("total") >= min_counts) & (F.col("genes") >= min_genes)).select("spot"), "spot", "left_semi")


def filter_genes(counts: DataFrame, below: float = 0.05, above: float = 1.0) -> DataFrame:
    """Genes detected in at least floor(below * n) and at most floor(above * n) of the n spots present."""
    n = counts.agg(F.count_distinct("spot").alias("n_spots"))
    per = counts.filter("count > 0").groupBy("gene").agg(F.count_distinct("spot").alias("detected"))
    good = per.join(F.broadcast(n)).filter((F.col("detected") >= F.floor(below * F.col("n_spots"))) & (F.col("detected") <= F.floor(above * F.col("n_spots"))))
    return counts.join(good.select("gene"), "gene", "left_semi")


def gene_moments(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, gene, n_spots, mean, var): mean and population variance over all spots of each sample, zeros included.

    The variance of the stored cells and that of the block of zeros are merged by their means, so that large
    counts lose no digits.
    """
    by = by or []
    n = counts.groupBy(*by).agg(F.count_distinct("spot").alias("n_spots"))
    per = counts.groupBy(*by, "gene").agg(F.count("count").alias("k"), F.avg("count").alias("mu"), F.var_pop("count").alias("s2"))
    both = per.join(F.broadcast(n), by) if by else per.crossJoin(F.broadcast(n))  # one row, or one a sample
    share = F.col("k") / F.col("n_spots")
    mean = share * F.col("mu")
    var = share * (F.col("s2") + (F.col("mu") - mean) ** 2) + (1 - share) * mean**2
    return both.select(*by, "gene", "n_spots", mean.alias("mean"), var.alias("var"))


def log_moments(moments: DataFrame) -> DataFrame:
    """Adds m = ln(mean) and v = ln(var); the logarithm of 0 is minus infinity, not null."""
    ln = lambda c: F.when(F.col(c) > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
    return moments.withColumns({"m": ln("mean"), "v": ln("var")})


def linear_residuals(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds res, the residual of v on m by least squares over the sample's genes with finite v; minus infinity for the others."""
    by = by or []
    logs = log_moments(moments)
    fit = logs.filter("var > 0 AND mean > 0").groupBy(*by).agg(F.regr_slope("v", "m").alias("slope"), F.regr_intercept("v", "m").alias("intercept"))
    res = F.when((F.col("var") > 0) & (F.col("mean") > 0), F.col("v") - F.col("slope") * F.col("m") - F.col("intercept")).otherwise(F.lit(float("-inf")))
    both = logs.join(F.broadcast(fit), by, "left") if by else logs.crossJoin(F.broadcast(fit))  # one row, or one a sample
    return both.withColumn("res", res).drop("slope", "intercept")


def spline_residuals(moments: DataFrame, knots: int = 5, penalty: float = 0.6) -> DataFrame:
    """As :func:`linear_residuals` with one penalised cubic spline; one row a gene goes to one task."""
    ship(moments.sparkSession)
    logs = log_moments(moments)
    schema = logs.schema.add("res", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        frames = list(batches)
        if not frames:
            return
        df = pd.concat(frames)
        ok = np.isfinite(df["v"]) & np.isfinite(df["m"])
        df["res"] = -np.inf
        if ok.sum() >= 1.5 * knots:
            x, y = df.loc[ok, "m"].to_numpy(), df.loc[ok, "v"].to_numpy()
            width = (x.max() - x.min()) / max(1, knots - 3) or 1.0
            centres = x.min() + width * (np.arange(knots) - 1)
            u = np.abs(x[:, None] - centres[None, :]) / width
            basis = np.where(u < 1, 2 / 3 - u**2 + u**3 / 2, np.where(u < 2, (2 - u) ** 3 / 6, 0))
            basis = np.concatenate((basis, np.ones((len(x), 1))), 1)
            rough = np.zeros((knots - 2, knots + 1))
            for i in range(knots - 2):
                rough[i, i : i + 3] = 1, -2, 1
            a = basis.T @ basis + penalty * rough.T @ rough + 1e-9 * np.eye(knots + 1)
            df.loc[ok, "res"] = y - basis @ np.linalg.solve(a, basis.T @ y)
        elif ok.sum() >= 2:
            x, y = df.loc[ok, "m"].to_numpy(), df.loc[ok, "v"].to_numpy()
            df.loc[ok, "res"] = y - np.polyval(np.polyfit(x, y, 1), x)
        yield df

    return logs.coalesce(1).mapInPandas(run, schema)


def adjust_p_values(df: DataFrame, p: str = "p_value", out: str = "p_value_adj", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: p * N / rank, the running minimum from the largest p down, at most 1."""
    w = Window.partitionBy(*(by or []))
    last = w.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("__n", F.count("*").over(w)).withColumn("__rank", F.count("*").over(last))
    down = w.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(down))).drop("__n", "__rank")


def overdispersed_genes(counts: DataFrame, alpha: float = 0.05, spline: bool = False, low: float = 1e-3, high: float = 1e3) -> DataFrame:
    """(gene, mean, var, m, v, res, p_value, p_value_adj, chi_qv, gene_scale_factor, is_odg) after the spot and gene filters.

    A gene without variance has res = -inf, p = 1, scale 0 and is not selected.
    """
    kept = filter_genes(filter_spots(counts))
    moments = gene_moments(kept)
    res = spline_residuals(moments) if spline else linear_residuals(moments)
    ship(counts.sparkSession)
    # one row a gene: small, and read twice
    rows = res.withColumn("genes", F.count("*").over(Window.partitionBy()))

    @F.pandas_udf("p double, q double")
    def tests(r: pd.Series, n: pd.Series, genes: pd.Series) -> pd.DataFrame:
        import numpy as np

        from tissueloom.functions.special import chi2_quantile, f_survival

        p = [f_survival(float(np.exp(min(x, 700.0))), float(k), float(k)) for x, k in zip(r, n)]
        return pd.DataFrame({"p": p, "q": [chi2_quantile(1 - x, g - 1) / g if g > 1 else 0.0 for x, g in zip(p, genes)]})

    tested = rows.withColumn("t", tests("res", F.col("n_spots").cast("double"), "genes"))
    tested = tested.withColumns({"p_value": F.col("t.p"), "chi_qv": F.col("t.q")}).drop("t", "genes")
    adjusted = adjust_p_values(tested)
    scale = F.when(F.col("var") > 0, F.sqrt(F.least(F.lit(high), F.greatest(F.lit(low), F.col("chi_qv"))) / F.col("var"))).otherwise(F.lit(0.0))
    return adjusted.withColumns({"gene_scale_factor": scale, "is_odg": F.col("p_value_adj") < alpha})


def scaled_counts(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts times the gene's scale factor; genes is one row a gene."""
    return counts.join(genes.select("gene", "gene_scale_factor"), "gene").withColumn("count", F.col("count") * F.col("gene_scale_factor")).drop("gene_scale_factor")


def log_normalise(counts: DataFrame, total: float = 1e4) -> DataFrame:
    """(spot, gene, value): ln(1 + count / spot total * total)."""
    sums = counts.groupBy("spot").agg(F.sum("count").alias("t"))
    return counts.join(sums, "spot").select("spot", "gene", F.when(F.col("t") > 0, F.log1p(F.col("count") / F.col("t") * total)).otherwise(F.lit(0.0)).alias("value"))


def density(counts: DataFrame) -> DataFrame:
    """Share of non-zero cells of the spot-by-gene matrix."""
    d = counts.agg(F.count_if(F.col("count") > 0).alias("nnz"), F.count_distinct("spot").alias("spots"), F.count_distinct("gene").alias("genes"))
    return d.select((F.col("nnz") / (F.col("spots") * F.col("genes"))).alias("density"))


def aggregate_by_type(counts: DataFrame, types: DataFrame, mean: bool = False) -> DataFrame:
    """(gene, celltype, value): sums, or means over all spots of the type; types: (spot, celltype), one row a spot."""
    sums = counts.join(types, "spot").groupBy("gene", "celltype").agg(F.sum("count").alias("value"))
    if not mean:
        return sums
    n = types.groupBy("celltype").agg(F.count("*").alias("n"))
    return sums.join(n, "celltype").select("gene", "celltype", (F.col("value") / F.col("n")).alias("value"))


def selected_in_samples(counts: DataFrame, samples: list[str], **options) -> DataFrame:
    """(gene, n_samples): genes over-dispersed in at least one sample, each tested on its own spots; counts: (sample_id, spot, gene, count)."""
    out = None
    for s in samples:  # a plan for each sample of a study; their rows stay apart from the first filter on
        found = overdispersed_genes(counts.filter(F.col("sample_id") == s).drop("sample_id"), **options).filter("is_odg").select("gene")
        out = found if out is None else out.union(found)
    return out.groupBy("gene").agg(F.count("*").alias("n_samples"))
