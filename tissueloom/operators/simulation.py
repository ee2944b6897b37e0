"""Synthetic spots: mixtures of cells, down-sampling, grids, class probabilities and bin squares.

All draws come from hashes of a seed and the row's own keys, so they do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tissueloom.shipping import ship


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) of the seed and the keys: the first 13 hexadecimal digits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def grid_locations(spark: SparkSession, n: int, width: int) -> DataFrame:
    """(spot, x, y): n spots in rows of ``width``."""
    return spark.range(n).select(F.col("id").alias("spot"), (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))


def class_probabilities(types: DataFrame, how: str = "raw") -> DataFrame:
    """(celltype, n, probability, weight): shares of cells, of their square roots, or equal; weight: of one cell, 1 / (classes * n)."""
    per = types.groupBy("celltype").agg(F.count("*").alias("n"))
    mass = {"raw": F.col("n").cast("double"), "sqrt": F.sqrt("n"), "balanced": F.lit(1.0)}[how]
    whole = Window.partitionBy()
    rows = per.withColumn("mass", mass)
    return rows.select("celltype", "n", (F.col("mass") / F.sum("mass").over(whole)).alias("probability"), (1.0 / (F.count("*").over(whole) * F.col("n"))).alias("weight"))


def cells_per_spot(spots: DataFrame, seed: int) -> DataFrame:
    """Adds n_cells = ceil of uniform(5, 15) cut to 4 .. 16 and n_types = ceil of uniform(2, 6) cut to 1 .. n_cells."""
    spot = F.col("spot").cast("string")
    cells = F.ceil(F.greatest(F.lit(4.0), F.least(F.lit(16.0), 5 + 10 * uniform(seed, "cells", spot)))).cast("int")
    rows = spots.withColumn("n_cells", cells)
    kinds = F.ceil(F.greatest(F.lit(1.0), F.least(F.col("n_cells").cast("double"), 2 + 4 * uniform(seed, "types", spot)))).cast("int")
    return rows.withColumn("n_types", kinds)


def mixture(spots: DataFrame, types: DataFrame, seed: int = 0, how: str = "raw") -> DataFrame:
    """(spot, draw, celltype, cell): cells drawn for each spot; types: (cell, celltype).

    A spot first draws its types by their probability, each draw then takes one of those types and one of its
    cells.  Picks find their place in running sums: the classes, a short table, are held with each draw as an
    array, and cells are found by number.
    """
    probs = class_probabilities(types, how)
    upto = F.sum("probability").over(Window.orderBy("celltype").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = probs.withColumn("upto", upto).agg(F.array_sort(F.collect_list(F.struct("upto", "celltype"))).alias("classes"))
    spot = F.col("spot").cast("string")
    rows = cells_per_spot(spots, seed).join(F.broadcast(table))
    pick = lambda u: F.coalesce(F.filter("classes", lambda c: c["upto"] > u)[0]["celltype"], F.element_at("classes", -1)["celltype"])
    own = F.transform(F.sequence(F.lit(1), F.col("n_types")), lambda k: pick(uniform(seed, "type", spot, k.cast("string"))))
    rows = rows.withColumn("own", own).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n_cells"))))
    draw = F.col("draw").cast("string")
    at = F.least(F.floor(uniform(seed, "of", spot, draw) * F.col("n_types")).cast("int"), F.col("n_types") - 1)
    drawn = rows.select("spot", "draw", F.element_at("own", at + 1).alias("celltype"), uniform(seed, "cell", spot, draw).alias("u"))
    numbered = types.withColumn("k", F.row_number().over(Window.partitionBy("celltype").orderBy("cell")) - 1)
    drawn = drawn.join(F.broadcast(probs.select("celltype", "n")), "celltype").withColumn("k", F.least(F.floor(F.col("u") * F.col("n")), F.col("n") - 1).cast("int"))
    return drawn.join(numbered, ["celltype", "k"]).select("spot", "draw", "celltype", "cell")


def mixed_counts(drawn: DataFrame, expression: DataFrame) -> DataFrame:
    """(spot, gene, count): summed expression (cell, gene, count) of the drawn cells."""
    return drawn.select("spot", "cell").join(expression, "cell").groupBy("spot", "gene").agg(F.sum("count").alias("count"))


def downsampled(counts: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Counts replaced by binomial draws; cells that come to 0 are left out.  A cell's draw depends on the seed and its keys alone."""
    ship(counts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        import numpy as np

        for df in batches:
            keys = [zlib.crc32(f"{seed}:{s}:{g}".encode()) for s, g in zip(df["spot"], df["gene"])]
            df["count"] = [float(np.random.default_rng([seed, k]).binomial(int(n), share)) for k, n in zip(keys, df["count"])]
            yield df[df["count"] > 0]

    rows = counts.select("spot", "gene", F.col("count").cast("double").alias("count"))
    return rows.mapInPandas(run, rows.schema)


def bounding_box(points: DataFrame, margin: float = 0.0) -> DataFrame:
    return points.agg((F.min("x") - margin).alias("x0"), (F.min("y") - margin).alias("y0"), (F.max("x") + margin).alias("x1"), (F.max("y") + margin).alias("y1"))


def cropped(points: DataFrame, box: DataFrame) -> DataFrame:
    """Points inside a box (one row)."""
    return points.join(F.broadcast(box), (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).select(*points.columns)


def bin_squares(points: DataFrame, bin_um: float, um_per_pixel: float) -> DataFrame:
    """Adds the corners of a square of ``bin_um`` micrometres around each point, in pixels."""
    half = bin_um / um_per_pixel / 2
    return points.withColumns({"x0": F.col("x") - half, "y0": F.col("y") - half, "x1": F.col("x") + half, "y1": F.col("y") + half})
