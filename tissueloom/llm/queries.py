"""The registered queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, counts, grammar, jaccard, mixing, pii, quality, repeats, topk
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), classifier.held_out)
    out = classifier.score(docs, model)
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, with_counts=True)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op6_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=True).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_compression_classifier, op3_ngram_jaccard, op4_pii_surrogates, op5_exact_topk, op6_grammar_ids, op7_bpe_round_trip, op8_token_counts, op9_suffix_repeats, op10_quality_rules)}

ORACLE_SQL = {"op1_mix_sources": mixing.ORACLE_SQL, "op3_ngram_jaccard": jaccard.ORACLE_SQL, "op5_exact_topk": topk.ORACLE_SQL, "op10_quality_rules": quality.ORACLE_SQL}
