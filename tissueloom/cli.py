"""Command line: factorise, deconvolve, annotate and network, from a folder of counts to a folder of results.

python -m tissueloom.cli deconvolve --matrix FOLDER --positions FILE --out FOLDER --k 10
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueloom.operators import annotation, counts as C, network, otnmf, programs as P
from tissueloom.operators.tables import select_genes, weight_by_admixture
from tissueloom.sources import loaders, readers, writers


def factorise(spark: SparkSession, table: DataFrame, out: str, settings: otnmf.Settings, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Usage and spectra of the selected genes, written with gene scores, ranked genes, the gene list and the run's time."""
    began = time.time()
    chosen = genes if genes is not None else C.overdispersed_genes(table).filter("is_odg").select("gene")
    kept = select_genes(C.filter_spots(table), chosen)
    usage, spectra, losses = otnmf.factorise(kept, settings)
    names = [f"ot_{k + 1}" for k in range(settings.k)]
    scores = P.gene_scores(C.filter_spots(table), usage)
    writers.wide_csv(usage, "spot", "program", "usage", names, f"{out}/topics_per_spot.csv")
    writers.wide_csv(spectra, "gene", "program", "weight", names, f"{out}/genes_per_topic.csv")
    writers.wide_csv(scores, "gene", "program", "score", names, f"{out}/genescores_per_topic.csv")
    writers.ranked_csv(P.rank_genes(spectra.withColumnRenamed("weight", "score")), names, f"{out}/ranked_genes.csv")
    writers.ranked_csv(P.rank_genes(scores), names, f"{out}/ranked_genescores.csv")
    writers.gene_list(kept.select("gene").distinct(), f"{out}/hvgs.csv")
    writers.timing(spark, time.time() - began, losses[-1] if losses else 0.0, f"{out}/timing")
    return usage, spectra


def annotate(spark: SparkSession, out: str, sets: str, top: int = 1000) -> DataFrame:
    """(set_name, program, score) of gene sets with the programs of a run, and over-representation, both written."""
    scores = loaders.result(spark, out, "", "genescores")
    ranked, genesets = P.rank_genes(scores), readers.gene_sets(spark, sets).select("set_name", "gene")
    found = annotation.marker_annotation(genesets, ranked.filter(F.col("rank") <= top))
    writers.tsv(found, f"{out}/marker_scores")
    writers.enrichment(annotation.enrichment(ranked, genesets, scores.select("gene").distinct().count(), top), f"{out}/enrichment")
    return found


def build_network(spark: SparkSession, out: str, genome: str | None = None, species: str | None = None, threshold: float = 0.0, n_bins: int = 100, edge_threshold: float = 0.199) -> dict[str, DataFrame]:
    """The co-occurrence network of a run's usages, weighted by the species' share where one is given, written by table."""
    usage = loaders.result(spark, out, "", "spots")
    if genome and species:
        usage = weight_by_admixture(usage, readers.species(spark, species).withColumnRenamed("barcode", "spot"), genome)
    found = network.network(usage, threshold, n_bins, edge_threshold)
    for name, df in found.items():
        writers.tsv(df, f"{out}/network/{name}")
    return found


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tissueloom", description=__doc__)
    modes = top.add_subparsers(dest="mode", required=True)
    for mode in ("factorise", "deconvolve"):
        p = modes.add_parser(mode)
        p.add_argument("--matrix", required=True)
        p.add_argument("--positions", required=mode == "deconvolve")
        p.add_argument("--sample", default="sample")
        p.add_argument("--prefix")
        p.add_argument("--genes", help="a headerless CSV of genes in place of the over-dispersed ones")
        p.add_argument("--k", type=int, required=True)
        for name, value in (("h", 0.05), ("w", 0.01), ("eps", 0.05), ("rate", 0.05)):
            p.add_argument(f"--{name}", type=float, default=value)
        p.add_argument("--inner", type=int, default=1000)
        p.add_argument("--outer", type=int, default=100)
        p.add_argument("--seed", type=int, default=42)
    modes.add_parser("annotate").add_argument("--sets", required=True)
    p = modes.add_parser("network")
    p.add_argument("--genome", choices=("GRCh38", "mm10"))
    p.add_argument("--species")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--n-bins", type=int, default=100)
    p.add_argument("--edge-threshold", type=float, default=0.199)
    for p in modes.choices.values():
        p.add_argument("--out", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tissueloom").getOrCreate()
    if a.mode in ("factorise", "deconvolve"):
        settings = otnmf.Settings(k=a.k, h=a.h, w=a.w, eps=a.eps, rate=a.rate, inner=a.inner, outer=a.outer, seed=a.seed)
        if a.mode == "deconvolve":
            table, spots = loaders.sample(spark, a.matrix, a.positions, a.sample, prefix=a.prefix)
            table = table.drop("sample_id")
        else:
            table = readers.matrix_market(spark, a.matrix)
        usage, _ = factorise(spark, table, a.out, settings, readers.gene_list(spark, a.genes) if a.genes else None)
        if a.mode == "deconvolve":
            writers.tsv(spots.join(usage.groupBy("spot").agg(F.max_by("program", F.struct("usage", "program")).alias("main_program")), "spot", "left"), f"{a.out}/spots")
    elif a.mode == "annotate":
        annotate(spark, a.out, a.sets)
    else:
        build_network(spark, a.out, a.genome, a.species, a.threshold, a.n_bins, a.edge_threshold)


if __name__ == "__main__":
    main()
