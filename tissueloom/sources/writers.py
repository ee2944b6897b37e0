"""Sinks: long tables as Parquet, wide exports as CSV, gene sets as GMT."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_csv(df: DataFrame, key: str, name: str, value: str, names: list[str], path: str) -> None:
    """One column for each of the given names."""
    df.groupBy(key).pivot(name, names).agg(F.first(value)).orderBy(key).write.mode("overwrite").csv(path, header=True)


def ranked_csv(ranked: DataFrame, programs: list[str], path: str) -> None:
    """One column of genes for each program, by rank."""
    ranked.groupBy("rank").pivot("program", programs).agg(F.first("gene")).orderBy("rank").write.mode("overwrite").csv(path, header=True)


def gene_list(genes: DataFrame, path: str) -> None:
    genes.select("gene").orderBy("gene").write.mode("overwrite").csv(path, header=False)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def gene_sets(ranked: DataFrame, description: str, path: str) -> None:
    """GMT lines: set, description, genes by rank."""
    sets = ranked.groupBy("program").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))), lambda r: r["gene"]).alias("genes"))
    sets.select(F.concat_ws("\t", "program", F.lit(description), F.array_join("genes", "\t")).alias("value")).write.mode("overwrite").text(path)


def enrichment(found: DataFrame, path: str, alpha: float = 0.05) -> None:
    """The results, and a summary of the sets below ``alpha`` by program, as TSV in two folders."""
    tsv(found, f"{path}/results")
    best = found.filter(F.col("p_value_adj") <= alpha).groupBy("program").agg(F.count("*").alias("n_sets"), F.min_by("set_name", F.struct("p_value_adj", "set_name")).alias("best_set"))
    tsv(best.orderBy("program"), f"{path}/summary")


def timing(spark, seconds: float, last_loss: float, path: str) -> None:
    """One row: duration and last loss."""
    spark.createDataFrame([(float(seconds), float(last_loss))], "duration double, last_loss double").write.mode("overwrite").csv(path, sep="\t", header=True)


def simulated(counts: DataFrame, locations: DataFrame, truth: DataFrame, cell_counts: DataFrame, path: str) -> None:
    """The four tables of a simulated data set, each a TSV folder."""
    for name, df in (("counts", counts), ("locations", locations), ("truth", truth), ("cell_counts", cell_counts)):
        tsv(df, f"{path}/{name}")


def best_values(scores: DataFrame, by: str, smaller_is_better: list[str], metric: str, value: str, path: str) -> None:
    """Scores with a mark on the best of each ``by`` and metric: the largest, or the smallest for those listed."""
    sign = F.when(F.col(metric).isin(*smaller_is_better), -F.col(value)).otherwise(F.col(value))
    tsv(scores.withColumn("is_best", sign == F.max(sign).over(Window.partitionBy(by, metric))), path)
