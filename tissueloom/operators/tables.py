"""Joins, filters and unions between spots, genes, programs, cell types and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lookup tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if a count of at most ``BROADCAST_ROWS`` + 1 rows shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_positions(spots: DataFrame, positions: DataFrame) -> DataFrame:
    """Spots with the columns of their position; spots without one keep nulls."""
    return spots.join(without_columns_of(positions, spots, "spot"), "spot", "left")


def without_columns_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df without the columns, key aside, that ``other`` has as well."""
    return df.drop(*[c for c in df.columns if c in other.columns and c != key])


def with_admixture(spots: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds GRCh38, mm10 and admix = mm10 / (mm10 + GRCh38) by spot; null where unknown or both are 0."""
    share = F.try_divide(F.col("mm10").cast("double"), F.col("mm10") + F.col("GRCh38"))
    return spots.join(classes.select("spot", "GRCh38", "mm10"), "spot", "left").withColumn("admix", share)


def weight_by_admixture(usage: DataFrame, admix: DataFrame, genome: str) -> DataFrame:
    """Usage times the share of the genome in its spot: 1 - admix for GRCh38, admix for mm10."""
    weight = {"GRCh38": 1 - F.col("admix"), "mm10": F.col("admix")}[genome]
    return usage.join(admix.select("spot", "admix"), "spot").select("spot", "program", (F.col("usage") * weight).alias("usage"))


def with_gene_statistics(genes: DataFrame, statistics: DataFrame) -> DataFrame:
    """Genes with their statistics; is_odg is false for genes that have none."""
    return genes.join(without_columns_of(statistics, genes, "gene"), "gene", "left").withColumn("is_odg", F.coalesce("is_odg", F.lit(False)))


def select_genes(counts: DataFrame, genes: DataFrame | None) -> DataFrame:
    """Counts of the listed genes, or all counts without a list."""
    return counts if genes is None else counts.join(small(genes.select("gene").distinct()), "gene", "left_semi")


def of_sample(df: DataFrame, prefix: str, column: str = "spot") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def wide_usage(spots: DataFrame, usage: DataFrame, programs: list[str]) -> DataFrame:
    """One row a spot with a column for each program, 0 where there is no usage."""
    wide = usage.groupBy("spot").pivot("program", programs).agg(F.sum("usage"))
    return spots.join(wide, "spot", "left").na.fill(0.0, programs)


def nodes_with_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(program, linked): whether a node has a link other than to itself."""
    ends = links.filter("source <> target").select(F.explode(F.array("source", "target")).alias("program")).distinct()
    return nodes.select("program").distinct().join(ends.withColumn("linked", F.lit(True)), "program", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def sets_with_sum(df: DataFrame, by: str, value: str, least: float, how: str = "sum") -> DataFrame:
    """Rows of the groups whose sum or mean of ``value`` reaches ``least``."""
    total = {"sum": F.sum, "mean": F.avg}[how](value)
    return df.join(df.groupBy(by).agg(total.alias("total")).filter(F.col("total") >= least).select(by), by, "left_semi")


def conditional_class(df: DataFrame, dataset: str, marks: dict[str, str], otherwise: str) -> DataFrame:
    """Adds class: the value of the first mark that the dataset's name contains."""
    found = F.lit(otherwise)
    for mark, value in reversed(marks.items()):
        found = F.when(F.col(dataset).contains(mark), value).otherwise(found)
    return df.withColumn("class", found)


def difference(df: DataFrame, by: list[str], column: str, value: str, one: str, two: str) -> DataFrame:
    """(by, difference): mean of ``value`` where column is ``one`` less that where it is ``two``."""
    mean = lambda name: F.avg(F.when(F.col(column) == name, F.col(value)))
    return df.groupBy(*by).agg((mean(one) - mean(two)).alias("difference"))


def usable(df: DataFrame, column: str, most: float) -> DataFrame:
    """Rows whose value is there, a number and at most ``most``."""
    c = F.col(column)
    return df.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= most))


def clean_label(column: str) -> Column:
    """A label without parentheses, with single underscores for other marks, and one spelling of T cell."""
    c = F.regexp_replace(F.col(column), "T cell", "Tcell")
    return F.regexp_replace(F.translate(c, "()", ""), "[^A-Za-z0-9]+", "_")


def frequent_types(df: DataFrame, by: str, least: int = 2, without: tuple[str, ...] = ("Not_specific",)) -> DataFrame:
    """Rows of types that have at least ``least`` rows and are not left out by name."""
    df = df.filter(~F.col(by).isin(*without))
    return df.join(df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(by), by, "left_semi")


def shared_rows(one: DataFrame, two: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the keys that are in both."""
    return one.join(two.select(key).distinct(), key, "left_semi"), two.join(one.select(key).distinct(), key, "left_semi")


def members_with(bins: DataFrame, cells: DataFrame, ids: str = "ids", key: str = "cell_id") -> DataFrame:
    """Bins with a list of members, one row a member, with the member's columns."""
    return bins.withColumn(key, F.explode(ids)).drop(ids).join(cells, key)


def mapped(df: DataFrame, mapper: DataFrame, key: str, missing: str = "NA") -> DataFrame:
    """Adds ``mapped`` from mapper (key, mapped); a null key is looked up as ``missing``."""
    rows = df.withColumn(key, F.coalesce(key, F.lit(missing)))
    return rows.join(small(mapper.select(key, "mapped").dropDuplicates([key])), key, "left")


def renamed(df: DataFrame, names: DataFrame, column: str = "program") -> DataFrame:
    """Values of ``column`` replaced by names (name, new_name); unknown ones stay."""
    look = small(names.select(F.col("name").alias(column), "new_name").dropDuplicates([column]))
    return df.join(look, column, "left").withColumn(column, F.coalesce("new_name", column)).drop("new_name")


def aligned_spot(column: str, prefix: str, numbers: dict[str, str]) -> Column:
    """A foreign spot id without its prefix: barcode-number, the sample in the last part by its number."""
    bare = F.regexp_replace(F.col(column), f"^{prefix}", "")
    sample, code = F.regexp_extract(bare, "^(.*)_[^_]*$", 1), F.regexp_extract(bare, "([^_]*)$", 1)
    look = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    return F.concat(code, F.lit("-"), F.coalesce(F.element_at(look, sample), F.lit("0")))


def stacked(frames: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """Tables under each other with their name in a column; columns that one lacks are null there."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(key, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def venn(one: DataFrame, two: DataFrame, item: str) -> DataFrame:
    """(only_one, only_two, shared): sizes of the parts of two sets, in one pass over both."""
    both = one.select(item).distinct().withColumn("side", F.lit(1)).union(two.select(item).distinct().withColumn("side", F.lit(2)))
    per = both.groupBy(item).agg(F.sum("side").alias("s"))
    return per.agg(*[F.count_if(F.col("s") == k).alias(n) for k, n in ((1, "only_one"), (2, "only_two"), (3, "shared"))])


def in_given_order(column: str, order: list[str]) -> Column:
    """Place of a value in a list of names, those not listed last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def number_in(column: str, pattern: str = r"x(\d+)_") -> Column:
    return F.regexp_extract(F.col(column), pattern, 1).try_cast("int")
