"""Loaders that compose readers: samples with positions, results of earlier runs, simulated data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueloom.operators.tables import of_sample, with_admixture, with_positions

from . import readers

#: File of each kind of result, under <folder>/<name>.
RESULTS = {"spots": "topics_per_spot.csv", "genes": "genes_per_topic.csv", "genescores": "genescores_per_topic.csv", "r_genes": "ranked_genes.csv", "r_genescores": "ranked_genescores.csv", "hvar": "hvgs.csv", "annotation": "annotation.csv"}


def sample(spark: SparkSession, matrix: str, positions: str, sample_id: str, species: str | None = None, aggregation: str | None = None, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts (sample_id, spot, gene, count), spots with positions, library and species share) of one sample.

    Positions are a headerless CSV or, for binned data, Parquet.  ``prefix`` keeps the spots that begin with it.
    """
    counts = readers.matrix_market(spark, matrix)
    placed = readers.positions_parquet(spark, positions) if positions.endswith(".parquet") else readers.positions_csv(spark, positions).withColumnRenamed("barcode", "spot")
    if prefix:
        counts = of_sample(counts, prefix)
    spots = with_positions(counts.select("spot").distinct(), placed)
    if species:
        spots = with_admixture(spots, readers.species(spark, species).withColumnRenamed("barcode", "spot"))
    if aggregation:
        spots = readers.library_of(spots, libraries(spark, aggregation))
    return counts.select(F.lit(sample_id).alias("sample_id"), "spot", "gene", "count"), spots.withColumn("sample_id", F.lit(sample_id))


def binned_sample(spark: SparkSession, folder: str, sample_id: str, bin_um: int = 8) -> tuple[DataFrame, DataFrame]:
    """As :func:`sample` from the usual layout of binned data."""
    root = f"{folder}/binned_outputs/square_{bin_um:03d}um"
    return sample(spark, f"{root}/filtered_feature_bc_matrix", f"{root}/spatial/tissue_positions.parquet", sample_id)


def samples(loaded: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several samples under each other, cut to the genes that all have; spots are named <sample>_<spot>."""
    name = F.concat_ws("_", "sample_id", "spot")
    join = lambda k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x[k].withColumn("spot", name) for x in loaded])
    return readers.samples_in_common(join(0)), join(1)


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """(position from 0, library_id) of an aggregation CSV, in the file's order."""
    rows = readers.numbered(spark, path, "line").withColumn("f", F.split("line", ","))
    header = rows.filter("row = 1").select(F.array_position("f", "library_id").alias("c"))
    both = rows.filter("row > 1").join(F.broadcast(header))
    return both.select((F.col("row") - 2).cast("int").alias("position"), F.element_at("f", F.col("c").cast("int")).alias("library_id"))


def result(spark: SparkSession, folder: str, name: str, mode: str, annotation: DataFrame | None = None) -> DataFrame:
    """A table of an earlier run; programs get their annotation if it is given, and columns that begin with the run's name go."""
    if mode not in RESULTS:
        raise ValueError(f"unknown result {mode!r}; choose of {sorted(RESULTS)}")
    path = f"{folder}/{name}/{RESULTS[mode]}"
    if mode == "hvar":
        return readers.gene_list(spark, path)
    if mode == "annotation":
        return readers.annotation(spark, path)
    if mode.startswith("r_"):
        return _ranked(spark, path)
    key, value = ("spot", "usage") if mode == "spots" else ("gene", "score")
    df = readers.wide_csv(spark, path, key, "program", value)
    df = df.filter(~F.col("program").startswith(name)) if name else df
    return df if annotation is None else readers.rename_programs(df, annotation)


def _ranked(spark: SparkSession, path: str) -> DataFrame:
    """(program, rank, gene) of a table with one column of genes for each program."""
    df = spark.read.csv(path, header=True)
    programs = [c for c in df.columns if c != "rank"]
    return df.withColumn("rank", F.col("rank").cast("int")).unpivot(["rank"], programs, "program", "gene").filter("gene IS NOT NULL").select("program", "rank", "gene")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, value) of a truth matrix."""
    return readers.wide_csv(spark, path, "key", "name", "value")


def tsv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def simulated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of :func:`tissueloom.sources.writers.simulated` by name."""
    return {n: tsv_table(spark, f"{folder}/{n}") for n in ("counts", "locations", "truth", "cell_counts")}


def single_cells(spark: SparkSession, counts: str, locations: str, types: str) -> DataFrame:
    """(cell, x, y, celltype, counts) of three headerless TSV files whose lines belong together by position."""
    c = readers.numbered(spark, counts, "line").withColumnRenamed("line", "counts")
    xy = readers.numbered(spark, locations, "x", "y").select("row", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    t = readers.numbered(spark, types, "celltype")
    return xy.join(t, "row").join(c, "row").withColumnRenamed("row", "cell")


def files(spark: SparkSession, folder: str, pattern: str = "*", prefix: str = "") -> DataFrame:
    """(path, stem) of the files below a folder whose names match and whose stems begin with ``prefix``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return found.select("path", stem.alias("stem")).filter(F.col("stem").startswith(prefix))


def bundled_sets(spark: SparkSession, folder: str, genome: str) -> DataFrame:
    """Gene-set files for a genome: mouse for mm10, human otherwise."""
    return files(spark, folder, "*.gmt", "mouse" if genome == "mm10" else "human")


def trials(spark: SparkSession, path: str) -> DataFrame:
    """(trial, score, loss) of a study table, CSV or Parquet."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    return df.select(F.col("trial").cast("long").alias("trial"), F.col("score").cast("double").alias("score"), F.col("loss").cast("double").alias("loss"))
