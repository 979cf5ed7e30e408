"""Batch insert of normalised articles: new urls only, new sources created on the way."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pressgauge.functions.text import at, digest_number
from pressgauge.operators.normalize import clean_feed, enrich, first_per_source
from pressgauge.operators.sentiment import lexicon_scores
from pressgauge.schemas import ARTICLES
from pressgauge.session import materialize


def first_new_urls(clean: DataFrame, stored: DataFrame) -> DataFrame:
    """First dated arrival per url over all sources, minus the urls already stored.

    Both aggregations run on (url, source, ingest_seq) only and combine before the
    exchange; the anti join then sees each url once.
    """
    dated = first_per_source(clean).filter("dated")
    first = dated.groupBy("url").agg(F.min("ingest_seq").alias("ingest_seq"))
    return first.join(stored.select("url"), "url", "left_anti").select("ingest_seq")


def undated(clean: DataFrame) -> DataFrame:
    """Rows that would have been normalised but carry no readable date: the quarantine."""
    return clean.join(first_per_source(clean).filter("NOT dated").select("ingest_seq"), "ingest_seq", "left_semi")


def new_sources(names: DataFrame, sources: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row per source name not stored yet. The id is a digest of the unique name."""
    fresh = names.select(F.col("source_name").alias("name")).distinct().join(sources.select("name"), "name", "left_anti")
    return fresh.select(
        digest_number(F.col("name")).alias("id"), "name", at(as_of).alias("created_at"), at(as_of).alias("updated_at")
    )


def upsert_sources(names: DataFrame, sources: DataFrame, as_of: datetime | str) -> DataFrame:
    """The source table after the lookup-or-create."""
    return sources.select("id", "name", "created_at", "updated_at").unionByName(new_sources(names, sources, as_of))


def rejected_sources(requested: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested names that already exist."""
    return requested.join(sources.select(F.col("name").alias("source_name")), "source_name", "left_semi")


def ingest_new_articles(
    raw: DataFrame, stored: DataFrame, lexicon: DataFrame, score=lexicon_scores
) -> DataFrame:
    """The rows to append, still with source_name; the id is a digest of the unique url.

    So it repeats exactly when a lost task is run again, and never meets a stored one by a restarted numbering.
    """
    clean = clean_feed(raw)
    rows = enrich(clean, first_new_urls(clean, stored), lexicon, score)
    return rows.select(digest_number(F.col("url")).alias("id"), *[c for c in rows.columns if c != "ingest_seq"])


def ingest(
    raw: DataFrame, articles: DataFrame, sources: DataFrame, lexicon: DataFrame, as_of: datetime | str, score=lexicon_scores
) -> tuple[DataFrame, DataFrame]:
    """The article rows to append, with source_id and all stored columns, and the source table after the run."""
    new = materialize(ingest_new_articles(raw, articles, lexicon, score))
    after = upsert_sources(new.select("source_name"), sources, as_of)
    return with_source_id(new, after), after


def with_source_id(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolve source_name against the (already extended) source dimension."""
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return articles.join(dim, "source_name").select(*[f.name for f in ARTICLES.fields])


def create_crawl_jobs(articles: DataFrame, jobs: DataFrame, as_of: datetime | str, limit: int | None = None) -> DataFrame:
    """A PENDING job for each article that has none; its id is a digest of article and instant, unlike any stored one."""
    return articles_without_jobs(articles, jobs, limit).select(
        digest_number(F.col("id"), at(as_of)).alias("id"), F.col("id").alias("article_id"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("boolean").alias("robots_allowed"), F.lit(None).cast("int").alias("http_status"),
        F.lit(None).cast("timestamp_ntz").alias("fetched_at"), F.lit(None).cast("long").alias("bytes_downloaded"),
        F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
        at(as_of).alias("created_at"), at(as_of).alias("updated_at"),
    )


def articles_without_jobs(articles: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Anti join on article id; with a limit, the lowest ids first."""
    # Distinct ids first: an article with very many jobs shrinks to one row before the exchange.
    done = jobs.select(F.col("article_id").alias("id")).distinct()
    rest = articles.join(done, "id", "left_anti")
    return rest.orderBy("id").limit(limit) if limit is not None else rest
