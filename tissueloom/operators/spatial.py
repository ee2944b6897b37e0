"""Operators over positions and categories: bins, range joins, histograms, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid_bins(points: DataFrame, width: float, open_: bool = False) -> DataFrame:
    """Adds bx, by and the bin centres; open_ drops points on a border (both ends strict) instead of the half-open rule."""
    out = points.withColumns({"bx": F.floor(F.col("x") / width), "by": F.floor(F.col("y") / width)})
    out = out.withColumns({"cx": (F.col("bx") + 0.5) * width, "cy": (F.col("by") + 0.5) * width})
    return out.filter((F.col("bx") * width < F.col("x")) & (F.col("by") * width < F.col("y"))) if open_ else out


def bin_sums(points: DataFrame, width: float) -> DataFrame:
    """(bx, by, n_cells, total): points and values in each bin."""
    return grid_bins(points, width).groupBy("bx", "by").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def bin_types(points: DataFrame, width: float, types: list[str]) -> DataFrame:
    """(bx, by, one count column for each type): the types are given, so that no pass looks for them."""
    return grid_bins(points, width).groupBy("bx", "by").pivot("type", types).agg(F.count("*")).na.fill(0)


def boxes_over_squares(boxes: DataFrame, squares: DataFrame, cell: float) -> DataFrame:
    """(box_id, square_id): boxes (x0, y0, x1, y1) that meet squares of the same form, by a grid of cells.

    Each side goes to the cells it covers; a pair that shares several is reported once, in the first.  Boxes of equal
    corners meet as one, with a list of their ids.  The cells are dealt over a fixed number of partitions: the input may
    be one small file and the result many times its size.
    """
    parts = 8 * boxes.sparkSession.sparkContext.defaultParallelism

    def dealt(df: DataFrame, prefix: str, ident: str) -> DataFrame:
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        whole = df.groupBy("x0", "y0", "x1", "y1").agg(F.collect_list(F.struct(ident)).alias(ident))  # a struct keeps null ids
        return whole.withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1")).select("gx", "gy", F.col(ident), *[F.col(c).alias(prefix + c) for c in ("x0", "y0", "x1", "y1")]).repartition(parts, "gx", "gy")

    both = dealt(boxes, "a", "box_id").join(dealt(squares, "b", "square_id"), ["gx", "gy"])
    both = both.filter("ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1")
    both = both.filter((F.col("gx") == F.floor(F.greatest("ax0", "bx0") / cell)) & (F.col("gy") == F.floor(F.greatest("ay0", "by0") / cell)))
    return both.select(F.explode("box_id").alias("b"), "square_id").select("b.box_id", F.explode("square_id").alias("s")).select("box_id", "s.square_id")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of each value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def density_bin(x: str):
    """D0 .. D4 for [0, .05], (.05, .2], (.2, .5], (.5, .8], (.8, 1]; null outside."""
    c = F.col(x)
    return F.when((c < 0) | (c > 1), None).when(c <= 0.05, "D0").when(c <= 0.2, "D1").when(c <= 0.5, "D2").when(c <= 0.8, "D3").when(c <= 1, "D4")


def admix_class(x: str):
    return F.when(F.col(x) > 0.9, "high").when(F.col(x) > 0.1, "mixed").otherwise("low")


def counts_above(df: DataFrame, value: str, by: str, thresholds: list[float]) -> DataFrame:
    """(by, threshold, n): values above each threshold, in one pass."""
    wide = df.groupBy(by).agg(*[F.count_if(F.col(value) > t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])).alias("r")).select(by, "r.threshold", "r.n")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n, density)."""
    h = df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy()) / width)


def memberships(sets: DataFrame) -> DataFrame:
    """(combination, n): items by the exact combination of sets that hold them; sets: (set_name, item)."""
    per = sets.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("set_name")), "+").alias("combination"))
    return per.groupBy("combination").agg(F.count("*").alias("n"))


def jaccard_of_sets(sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of sets that share an item, a < b."""
    sets = sets.distinct()
    n = sets.groupBy("set_name").agg(F.count("*").alias("n"))
    both = sets.select(F.col("set_name").alias("a"), "item").join(sets.select(F.col("set_name").alias("b"), "item"), "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    full = both.join(n.select(F.col("set_name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("set_name").alias("b"), F.col("n").alias("nb")), "b")
    return full.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"))


def last_by(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each group."""
    return df.groupBy(by).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != by]), order).alias("r")).select(by, "r.*")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeats of a name get -1, -2, ... in the given order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(k > 0, F.concat(F.col(name), F.lit("-"), k.cast("string"))).otherwise(F.col(name)))


def seconds(hms: str):
    part = F.split(F.col(hms), ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def sample_per_group(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, those with the smallest hashes of their key."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")
