"""Annotation of programs against references, and evaluation of matched programs and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import programs as P
from .tables import shared_rows

PROFILE_METHODS = ("pearson", "spearman", "cosine")
LIST_METHODS = ("rbo", "rboext", "mgs")


def top_by_set_size(genesets: DataFrame, ranked: DataFrame, most: int = 1000) -> DataFrame:
    """(set_name, program, gene, rank): of each program the first min(2 * size of the set, most) genes, for each set."""
    sizes = genesets.groupBy("set_name").agg(F.least(2 * F.count_distinct("gene"), F.lit(most)).alias("upto"))
    # the rank bound is the join's condition, so no pair holds more rows than it keeps
    return sizes.join(ranked.select("program", "gene", "rank"), F.col("rank") <= F.col("upto")).select("set_name", "program", "gene", "rank")


def with_zero_pairs(scores: DataFrame, a: str, names_a: DataFrame, b: str, names_b: DataFrame) -> DataFrame:
    """Every pair of the two short lists of names, score 0 where there is none."""
    every = F.broadcast(names_a.select(a).distinct()).join(names_b.select(b).distinct())
    return every.join(scores, [a, b], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def marker_annotation(genesets: DataFrame, ranked: DataFrame) -> DataFrame:
    """(set_name, program, score) of every set with every program: mean rank scores, 0 where no gene is shared."""
    return with_zero_pairs(P.mean_rank_score(genesets, ranked), "set_name", genesets, "program", ranked)


def annotate(one: DataFrame, two: DataFrame, method: str = "pearson", top: int = 100) -> DataFrame:
    """(a, b, score) by any method; both: (key, name, value).

    Profiles are compared over all keys of ``two``; list methods rank the keys of each name by falling value and
    compare the first ``top``.
    """
    if method in PROFILE_METHODS:
        return P.similarity(one, two, method)
    if method not in LIST_METHODS:
        raise ValueError(f"unknown method {method!r}; choose of {PROFILE_METHODS + LIST_METHODS}")

    def lists(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("name").orderBy(F.desc("value"), "key")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("name", F.col("key").alias("item"), "rank")

    if method == "mgs":
        sets = lists(two).select(F.col("name").alias("set_name"), F.col("item").alias("gene"))
        ranked = lists(one).select(F.col("name").alias("program"), F.col("item").alias("gene"), "rank")
        return P.mean_rank_score(sets, ranked).select(F.col("program").alias("a"), F.col("set_name").alias("b"), "score")
    return P.rank_biased_overlap(lists(one), lists(two), 1.0 if method == "rbo" else 0.98)


def best_per_row(scores: DataFrame, by: str = "a", largest: bool = True) -> DataFrame:
    """Adds is_best: whether the score is its row's largest (or smallest)."""
    w = Window.partitionBy(by)
    return scores.withColumn("is_best", F.col("score") == (F.max if largest else F.min)("score").over(w))


def nth_largest(df: DataFrame, by: str, value: str, n: int = 3, instead_of_zero: float = 1e-4) -> DataFrame:
    """(by, value): the n-th largest value of each group, or its smallest if there are fewer; 0 gives way to a small value."""
    w = Window.partitionBy(by).orderBy(F.desc(value))
    top = df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).groupBy(by).agg(F.min(value).alias(value))
    return top.withColumn(value, F.when(F.col(value) == 0, instead_of_zero).otherwise(F.col(value)))


def argmax_order(scores: DataFrame) -> DataFrame:
    """(a, best, top, place): rows by the column of their largest score, then by that score falling; ties by name."""
    per = scores.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("best"), F.max("score").alias("top"))
    return per.withColumn("place", F.row_number().over(Window.orderBy("best", F.desc("top"), "a")))


def cell_correlations(cells: DataFrame, programs: DataFrame, types: DataFrame) -> DataFrame:
    """(celltype, program, score): mean over a type's cells of each cell's Pearson correlation with the program; cells without one are left out.

    cells: (key, name: cell, value); programs: (key, name, value); types: (cell, celltype).
    """
    by_cell = P.similarity(cells, programs, "pearson").filter("score IS NOT NULL")
    return by_cell.join(types, by_cell["a"] == types["cell"]).groupBy("celltype", F.col("b").alias("program")).agg(F.avg("score").alias("score"))


def matched_against_standard(one: DataFrame, standard: DataFrame, method: str = "pearson") -> DataFrame:
    """(a, b, score, place): greedy one-to-one matches over the keys that both tables share."""
    left, right = shared_rows(one, standard, "key")
    return P.greedy_match(annotate(left, right, method)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "a")))


def self_similarity(reference: DataFrame, method: str = "pearson") -> DataFrame:
    return annotate(reference, reference, method).orderBy("a", "b")


def mean_match(matches: DataFrame) -> DataFrame:
    """(n, mean) of matched scores."""
    return matches.agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def matches_above(matches: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n): matches with a larger score."""
    wide = matches.agg(*[F.count_if(F.col("score") > t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")


def best_trial(trials: DataFrame, most: float = 0.1) -> DataFrame:
    """Of the three trials first by falling score and rising loss, the first with a loss below ``most``, else the first; trials: (trial, score, loss)."""
    three = trials.orderBy(F.desc("score"), "loss", "trial").limit(3)
    return three.orderBy(F.when(F.col("loss") < most, 0).otherwise(1), F.desc("score"), "loss", "trial").limit(1)


def pareto_front(trials: DataFrame) -> DataFrame:
    """Trials that no other beats in score without more loss, or in loss without less score.

    Going through trials by rising loss, a trial stays if it has the best score of all with at most its loss and
    beats that of all with less: running maxima, no pairs.
    """
    upto = Window.orderBy("loss").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = trials.groupBy("loss").agg(F.max("score").alias("top"))
    before = F.max("top").over(Window.orderBy("loss").rowsBetween(Window.unboundedPreceding, -1))
    front = per.withColumn("before", before).filter("before IS NULL OR top > before").select("loss", F.col("top").alias("score"))
    return trials.join(front, ["loss", "score"]).select("trial", "score", "loss")


def enrichment(ranked: DataFrame, genesets: DataFrame, population: int, top: int = 1000, low: int = 10, high: int = 2000) -> DataFrame:
    """Over-representation of sets of ``low`` .. ``high`` genes among each program's first ``top`` genes, names cleaned, with -log10 p."""
    names = genesets.withColumn("set_name", F.trim(F.regexp_replace("set_name", "[_\\s]+", " ")))
    sizes = names.groupBy("set_name").agg(F.count_distinct("gene").alias("size")).filter(F.col("size").between(low, high)).select("set_name")
    found = P.over_representation(names.join(sizes, "set_name", "left_semi"), ranked.filter(F.col("rank") <= top), population)
    return found.withColumn("minus_log10_p", -F.log10(F.greatest(F.col("p_value"), F.lit(1e-300))))


def statistics_by_program(found: DataFrame, programs: list[str]) -> DataFrame:
    """One row a set; columns <statistic>_<program> for p, list size and overlap, 0 where a program has none."""
    wide = found.groupBy("set_name").pivot("program", programs).agg(F.max("minus_log10_p").alias("log10p"), F.max("list_size").alias("query_size"), F.max("overlap").alias("intersection"))
    return wide.na.fill(0)
