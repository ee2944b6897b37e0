"""Readers of the input formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_col_in_fullres double, pxl_row_in_fullres double"


def positions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tissue positions."""
    return spark.read.schema(POSITIONS).csv(path, header=False)


def positions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Tissue positions of binned data; other columns are kept."""
    return spark.read.parquet(path).withColumnRenamed("barcode", "spot")


def _placed(lines: DataFrame) -> DataFrame:
    """Lines of one file with what orders them: the start of their split and their place in it."""
    return lines.withColumns({"split": F.input_file_block_start(), "at": F.monotonically_increasing_id()})


def matrix_market(spark: SparkSession, folder: str) -> DataFrame:
    """(spot, gene, count) of a folder with matrix.mtx, features.tsv (or genes.tsv) and barcodes.tsv, plain or .gz.

    The first line that is no comment holds the sizes and is left out.
    """
    lines = _placed(spark.read.text(f"{folder}/matrix.mtx*")).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = lines.agg(F.min(F.struct("split", "at")).alias("first"))
    cells = lines.join(F.broadcast(first), F.struct("split", "at") != F.col("first")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    cells = cells.select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), F.col("p")[2].cast("double").alias("count"))
    genes, spots = numbered(spark, f"{folder}/{{features,genes}}.tsv*", "gene"), numbered(spark, f"{folder}/barcodes.tsv*", "spot")
    return cells.join(genes.withColumnRenamed("row", "i"), "i").join(spots.withColumnRenamed("row", "j"), "j").select("spot", "gene", "count")


def numbered(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(row, names) of the first tab-separated fields of one file, rows from 1 in its order: splits are counted, and lines numbered within them."""
    lines = _placed(spark.read.text(path)).filter(F.col("value") != "")
    starts = lines.groupBy("split").agg(F.count("*").alias("n"), F.min("at").alias("low"))  # one row a split
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("split").orderBy("at"))
    rows = lines.withColumn("k", local).join(F.broadcast(starts.withColumn("before", before)), "split")
    fields = F.split("value", "\t")
    return rows.select((F.col("before") + F.col("k")).alias("row"), *[fields[k].alias(n) for k, n in enumerate(names)])


def gene_sets(spark: SparkSession, path: str, has_description: bool = True, trim: bool = True) -> DataFrame:
    """(collection, set_name, rank, gene) of GMT files; field 2 is a description or, without one, the first gene."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.gmt)?$", 1).alias("collection"), F.split("value", "\t").alias("f")).filter(F.size("f") > 1)
    each = lines.select("collection", F.col("f")[0].alias("set_name"), F.posexplode(F.slice("f", 3 if has_description else 2, F.size("f"))).alias("at", "gene"))
    gene = F.trim("gene") if trim else F.col("gene")
    return each.select("collection", "set_name", (F.col("at") + 1).alias("rank"), gene.alias("gene")).filter("gene <> ''")


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gene string").csv(path, header=False)


def species(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, GRCh38, mm10, admix)."""
    rows = spark.read.schema("barcode string, GRCh38 double, mm10 double").csv(path, header=True)
    return rows.withColumn("admix", F.try_divide("mm10", F.col("GRCh38") + F.col("mm10")))


def scale_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("spot_diameter_fullres double, tissue_hires_scalef double, fiducial_diameter_fullres double, tissue_lowres_scalef double").json(path, multiLine=True)


def wide_csv(spark: SparkSession, path: str, key: str, name: str, value: str) -> DataFrame:
    """A matrix CSV with its index first, as (key, name, value)."""
    df = spark.read.csv(path, header=True)
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias(key), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot([key], rest, name, value)


def annotation(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    if missing := {"Program", "Annotation"} - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df.select(F.col("Program").alias("program"), F.col("Annotation").alias("annotation"))


def rename_programs(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, "program", "left").withColumn("program", F.concat_ws("_", "program", "annotation")).drop("annotation")


def strip_genome(gene: str):
    return F.regexp_replace(gene, "^(mm10___|GRCh38_)", "")


def training_log(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """The groups of a pattern in each matching line."""
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).alias(c) for k, c in enumerate(columns)])


def samples_in_common(counts: DataFrame) -> DataFrame:
    """Counts of genes that every sample has; counts: (sample_id, spot, gene, count)."""
    n = counts.agg(F.count_distinct("sample_id").alias("n"))
    shared = counts.groupBy("gene").agg(F.count_distinct("sample_id").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("gene")
    return counts.join(shared, "gene", "left_semi")


def library_of(spots: DataFrame, libraries: DataFrame) -> DataFrame:
    """Adds library_id by the barcode's suffix; libraries: (position from 0, library_id)."""
    return spots.withColumn("position", F.element_at(F.split("spot", "-"), -1).cast("int") - 1).join(F.broadcast(libraries), "position", "left").drop("position")
