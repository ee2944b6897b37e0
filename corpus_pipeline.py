"""A corpus pipeline: quality rules, near duplicates, personal data, source mix, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueloom.llm import bpe, jaccard, mixing, pii, quality
from tissueloom.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them null and empty texts and those below fifty words."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 or more, the one with the smallest id stays, null ids last; rows that share an id but no text are different documents, and rows without words all stay."""
    return jaccard.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars follows where the text has changed."""
    if "n_chars" not in docs.columns:
        return pii.replace(docs)
    before = next(c for c in (f"before{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    out = pii.replace(docs.withColumn(before, F.xxhash64("text")))
    changed = ~F.xxhash64("text").eqNullSafe(F.col(before))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are left out, a null source is one of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix; null texts count as empty."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Tokens and keyed surrogates are beyond SQL; the stages' operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
