"""Pair counts of programs over a stream of spots that arrive whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(spots: DataFrame) -> DataFrame:
    """(one, two, pos) as a running aggregate; spots: (spot, programs: active programs of the spot)."""
    pairs = spots.select(F.explode("programs").alias("one"), F.col("programs")).select("one", F.explode("programs").alias("two"))
    return pairs.groupBy("one", "two").agg(F.count("*").alias("pos"))
