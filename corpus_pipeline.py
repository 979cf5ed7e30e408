"""From raw documents to a training mix: quality, repeated lines, near duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each result as Parquet
to the shared folder and reads it again for the next. All stages but the last return the columns of documents; the last
returns the blocks of the mix with the ids of the documents in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge.llm import decontaminate, jaccard, lines, mixing, quality
from pressgauge.llm.frames import stored, table
from pressgauge.session import prepare


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose perplexity their language's threshold allows (operator 1)."""
    prepare(spark)
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return quality.accepted(docs, trusted)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one (operator 10); texts of nothing else go, empty ones stay."""
    cleaned = lines.dedup(docs, counts=True, short=True)
    left = F.col("text").isNull() | (F.col("n_dropped") == 0) | F.rlike("text", F.lit(r"\S"))
    return cleaned.where(left).select(*docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (operator 9)."""
    return jaccard.distinct_documents(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate (operator 2)."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of a mix with source weights 1, 2, 3, repeating (operator 5)."""
    return mixing.mixed_blocks(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
]

# The model of the first stage and the draws of the last are beyond SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
