"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variable divided by its quality weight; ascending keys are a weighted
sample without replacement.  A source's target is met by complete epochs first, and the rest by the
documents with the smallest keys whose sizes add up to it.  Running sums never gather a source in one task:
the keys are cut into 256 intervals, three times over, so each step is a sum by (source, interval), and only
the documents of one last interval are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

WEIGHTS = (5, 2, 1)
CAP = 3
CUTS = 256
LEVELS = 3
SEED = "mix-1"


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)).cast("long"), F.lit(0))


def quality_weight(text_col: str):
    """1 for a text without digits and symbols, down to 0.1; 1 for null and empty texts."""
    c = F.col(f"`{text_col}`")
    plain = F.length(F.translate(c, "#*$%&|<>0123456789", ""))
    return F.coalesce(F.try_divide(plain.cast("double"), F.length(c).cast("double")) * 0.9 + 0.1, F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn.  All sizes are shared out by weight, no
    target above ``cap`` times its source's size.  With sources in the order of cap * size / weight, those
    capped come first, and the level shared by the rest follows from whole-number sums.  Past the first
    source that is not capped the level only falls, so the highest one is the right one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("long")).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    rows = rows.withColumn("weight_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", F.col("left") / F.col("weight_left"))
    rows = rows.withColumn("shared", F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("shared") * F.col("w"), F.col("most").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, weight=None, carry: bool = False) -> DataFrame:
    """(id_col, source, size, source_size, target, times, taken) for every row.

    times is how often the mix holds the document, taken its size times that.  size is the number of words
    (null and empty: 0; such documents are never taken beyond complete epochs and add nothing).  Equal keys,
    as of repeated rows, are ordered by size and a hash of the text, and then are alike.  A null source is a
    source of its own; rows with a null id are told apart by their text.  ``weight`` is a column of positive quality weights.
    With carry, the whole row stands in column ``row`` as well.
    """
    quality = quality_weight(text_col) if weight is None else weight
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("~"), F.md5(F.col(f"`{text_col}`").cast("binary"))), F.lit("~"))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), ident)), 1, 13), 16, 10).cast("double")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(text_col).alias("size"),
        (-F.log((digits + 0.5) / float(1 << 52)) / quality).alias("key"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    whole = ["row"] if carry else []
    rows = materialize(rows.withColumn("place", F.lit(1.0) - F.exp(-F.col("key"))), "keys")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    aims = materialize(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "targets")
    # of 0 .. CUTS ** LEVELS - 1; a number's leading digits in base CUTS are its interval at each level
    fine = CUTS**LEVELS
    rows = rows.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("slot", F.least(F.floor(F.col("place") * fine), F.lit(fine - 1)).cast("long"))
    # edge: the interval in which the rest is reached, and what was taken before it
    edge = aims.select("named", F.col("rest"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        width = CUTS ** (LEVELS - level)
        here = rows.join(edge.select("named", "edge"), "named")
        inside = here.filter(F.floor(F.col("slot") / (width * CUTS)) == F.col("edge"))
        sums = inside.groupBy("named", F.floor(F.col("slot") / width).alias("part")).agg(F.sum("size").alias("n"))
        # one row per source holds its at most CUTS sums
        parts = sums.groupBy("named").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
        step = edge.join(parts, "named", "left")
        walked = F.aggregate(
            F.coalesce("parts", F.array().cast("array<struct<part:bigint,n:bigint>>")),
            F.struct(F.col("before").alias("before"), F.lit(-1).cast("long").alias("edge"), F.lit(False).alias("over")),
            lambda s, p: F.when(s["over"], s).when(s["before"] + p["n"] >= F.col("rest"), F.struct(s["before"].alias("before"), p["part"].alias("edge"), F.lit(True).alias("over"))).otherwise(F.struct((s["before"] + p["n"]).alias("before"), p["part"].alias("edge"), F.lit(False).alias("over"))),
        )
        step = step.withColumn("walked", walked)
        # a source taken whole (only by rounding) ends after its last interval, whose sum is then counted twice: step back
        last = F.when(F.col("walked.over") | F.col("parts").isNull(), F.lit(0)).otherwise(F.element_at("parts", -1)["n"])
        edge = materialize(step.select("named", "rest", F.col("walked.edge").alias("edge"), (F.col("walked.before") - last).alias("before")), f"edge{level}")
    joined = rows.join(edge.select("named", "edge", "before", "rest"), "named")
    last = joined.filter(F.col("slot") == F.col("edge"))
    order = Window.partitionBy("named").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # the document that crosses the mark is taken if that comes nearer
    last = last.withColumn("extra", ((F.col("rest") > 0) & (F.col("ahead") + F.col("size") / 2 <= F.col("rest"))).cast("long"))
    rest = joined.filter(F.col("slot") != F.col("edge")).withColumn("extra", ((F.col("slot") < F.col("edge")) & (F.col("rest") > 0)).cast("long"))
    both = rest.select("id", "named", "size", "extra", *whole).union(last.select("id", "named", "size", "extra", *whole))
    out = both.join(aims, "named").withColumn("times", (F.col("epochs") + F.col("extra")).cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), *whole)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, with its columns; empty texts are left out."""
    found = mix(docs, carry=True, **options).filter("taken > 0")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / coalesce(CASE WHEN length(text) > 0 THEN CAST(length(translate(text, '#*$%&|<>0123456789', '')) AS DOUBLE) / CAST(length(text) AS DOUBLE) END * 0.9 + 0.1, 1.0) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(max(CASE WHEN most / w > level THEN level END) OVER () * w, CAST(most AS DOUBLE))) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rest > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
