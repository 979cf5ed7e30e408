"""The append-only sentiment event log."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge import settings
from pressgauge.functions.text import at
from pressgauge.schemas import SENTIMENT_EVENTS
from pressgauge.sources import tables
from pressgauge.sources.versions import Versions


def build_events(analyses: DataFrame, articles: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """One event row per analysis, with its article's metadata.

    The instant is ``as_of``, or the analysis time of each row when not given.
    ``articles`` carries source_name. Language, country and category come from
    the article; language falls back to the default.
    """
    a = articles.select(
        F.col("id").alias("article_id"), F.col("url").alias("article_url"), F.col("title").alias("article_title"),
        "source_name", "published_at", F.col("language").alias("article_language"), "country", "category",
    )
    instant = at(as_of) if as_of is not None else F.col("analyzed_at")
    rows = analyses.join(a, "article_id").withColumn("ingested_at", instant)
    extra = set(analyses.columns)

    def optional(name: str, kind: str):
        return (F.col(name) if name in extra else F.lit(None)).cast(kind)

    epoch = F.unix_seconds(F.col("ingested_at").cast("timestamp"))
    return rows.select(
        F.concat_ws("_", F.col("article_id"), F.col("provider"), epoch).alias("event_id"),
        "article_id", "article_url", "article_title", "source_name", "published_at", "ingested_at",
        F.col("provider").alias("sentiment_provider"),
        F.coalesce(optional("model_name", "string"), F.lit(settings.PROVIDERS[0][3])).alias("sentiment_model"),
        F.col("score").cast("double").alias("sentiment_score"),
        optional("magnitude", "double").alias("sentiment_magnitude"),
        F.col("label").alias("sentiment_label"),
        optional("confidence", "double").alias("confidence"),
        F.coalesce("article_language", F.lit(settings.DEFAULT_LANGUAGE)).alias("language"),
        "country", "category",
        optional("content_length", "long").alias("content_length"),
        optional("processing_time_ms", "long").alias("processing_time_ms"),
        F.coalesce(optional("extraction_method", "string"), F.lit("web_crawl")).alias("extraction_method"),
    )


def event_table(spark: SparkSession, path: str) -> Versions:
    return tables.by_days(spark, "sentiment_events", path, SENTIMENT_EVENTS)


def append_events(events: DataFrame, path: str) -> bool:
    """Best-effort append of the events that the log lacks, by event id, so a retry adds nothing.

    A failing sink is reported, not raised.
    """
    try:
        table = event_table(events.sparkSession, path)
        table.append(table.missing(events.dropDuplicates(["event_id"]), ["event_id"]))
        return True
    except Exception as error:  # the crawl's own results must survive a sink outage
        logging.getLogger(__name__).error("event sink failed: %s", error)
        return False


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log with its day column ``ingested_date`` for partition pruning."""
    return event_table(spark, path).read()
