"""The content store: short text, full hash, expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge import settings
from pressgauge.functions.text import at, hours


def expires_at(extracted: Column, ttl_hours: int = settings.CONTENT_TTL_HOURS) -> Column:
    return extracted + hours(ttl_hours)


def is_expired(as_of: datetime | str) -> Column:
    """Inclusive: content expiring exactly now is expired."""
    return F.col("expires_at") <= at(as_of)


def content_store(texts: DataFrame, ttl_hours: int = settings.CONTENT_TTL_HOURS) -> DataFrame:
    """(article_id, text, extracted_at) to stored rows.

    Hash and length describe the whole text; only the stored column is cut.
    """
    return texts.select(
        F.col("article_id").alias("id"), "article_id",
        F.substring("text", 1, settings.CONTENT_MAX_CHARS).alias("content_text"),
        F.sha2("text", 256).alias("content_hash"),
        F.char_length("text").alias("content_length"),
        "extracted_at", expires_at(F.col("extracted_at"), ttl_hours).alias("expires_at"),
    )


def content_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The content table after replacing or inserting by article id."""
    return stored.join(new.select("article_id"), "article_id", "left_anti").unionByName(new)


def ttl_split(contents: DataFrame, as_of: datetime | str) -> DataFrame:
    return contents.withColumn("expired", is_expired(as_of))


def ttl_cleanup(contents: DataFrame, as_of: datetime | str) -> DataFrame:
    """What remains after the cleanup. On a table split by ``expires_date``, whole expired days are never read."""
    kept = contents.filter(F.col("expires_at") > at(as_of))
    if "expires_date" in contents.columns:
        kept = kept.filter(F.col("expires_date") >= F.to_date(at(as_of)))
    return kept


def content_statistics(contents: DataFrame, as_of: datetime | str) -> DataFrame:
    gone = F.count_if(is_expired(as_of))
    return contents.agg(
        F.count("*").alias("total_records"), (F.count("*") - gone).alias("active_records"),
        gone.alias("expired_records"),
        F.coalesce(F.round(F.avg("content_length"), 2), F.lit(0.0)).alias("average_content_length"),
    )


def content_cleanup_report(contents: DataFrame, as_of: datetime | str) -> DataFrame:
    """Deleted, found and remaining counts with the oldest and newest survivor, in one pass."""
    gone = is_expired(as_of)
    return contents.agg(
        F.count_if(gone).alias("expired_content_deleted"), F.count_if(gone).alias("expired_content_found"),
        F.count_if(~gone).alias("total_content_remaining"),
        F.min(F.when(~gone, F.col("extracted_at"))).alias("oldest_content_date"),
        F.max(F.when(~gone, F.col("extracted_at"))).alias("newest_content_date"),
        at(as_of).alias("cleanup_timestamp"),
    )
