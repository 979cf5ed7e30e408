"""Raw feed items to clean, deduplicated, scored articles.

Decisions are made on narrow rows (keys and ``ingest_seq``) that pre-aggregate
before they move. Article texts move once, hashed by the unique
``ingest_seq``, so a url or source that holds most of the feed is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgauge.functions.text import canonical_url, parse_iso, strip
from pressgauge.operators.sentiment import lexicon_scores
from pressgauge.session import materialize


def clean_feed(raw: DataFrame) -> DataFrame:
    """Trim, drop rows lacking title, description or url, derive the stored columns."""
    return (
        raw.withColumns({"title": strip(F.col("title")), "description": strip(F.col("description"))})
        .filter("title <> '' AND description <> '' AND url <> ''")
        .select(
            "ingest_seq", "source_name", "title", "description",
            canonical_url(F.col("url")).alias("url"),
            F.coalesce(F.nullif("image", F.lit("")), "image_url").alias("image_url"),
            parse_iso(F.col("published_at")).alias("published_at"),
            "language", "country", "category",
        )
    )


def first_per_source(clean: DataFrame) -> DataFrame:
    """First arrival per (url, source): url, ingest_seq, and whether its date parsed."""
    return clean.groupBy("url", "source_name").agg(
        F.min("ingest_seq").alias("ingest_seq"),
        F.min_by(F.col("published_at").isNotNull(), "ingest_seq").alias("dated"),
    )


def dedup_feed(clean: DataFrame) -> DataFrame:
    return clean.join(first_per_source(clean).select("ingest_seq"), "ingest_seq", "left_semi")


def scoring_text():
    return F.concat_ws(" ", "title", "description")


def enrich(clean: DataFrame, chosen: DataFrame, lexicon: DataFrame, score=lexicon_scores) -> DataFrame:
    """The chosen rows (``ingest_seq``) with label and score of "title description".

    Only chosen rows are scored. They are written once, so the feed is not read again for their texts.
    """
    picked = materialize(clean.join(chosen.select("ingest_seq"), "ingest_seq", "left_semi"))
    scores = score(picked.select("ingest_seq", scoring_text().alias("text")), "ingest_seq", "text", lexicon)
    labels = scores.select("ingest_seq", F.col("label").alias("sentiment_label"), F.col("score").alias("sentiment_score"))
    return picked.join(labels, "ingest_seq")


def normalize_articles(raw: DataFrame, lexicon: DataFrame, score=lexicon_scores) -> DataFrame:
    clean = clean_feed(raw)
    return enrich(clean, first_per_source(clean), lexicon, score)
