"""The ingestion run on stored tables: new sources, then new articles, with counts taken while writing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge.functions.text import at
from pressgauge.operators.ingest import ingest_new_articles, new_sources, undated, with_source_id
from pressgauge.operators.normalize import clean_feed
from pressgauge.operators.sentiment import lexicon_scores
from pressgauge.schemas import ARTICLES, SOURCES
from pressgauge.session import materialize_counted
from pressgauge.sources.feeds import raw_feed, unreadable_responses
from pressgauge.sources.versions import Versions


def open_tables(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, Versions]:
    """The articles as the crawl run keeps them, and the sources."""
    return {
        "articles": Versions.buckets(spark, f"{root}/articles", ARTICLES, ["id"], buckets),
        "sources": Versions.buckets(spark, f"{root}/sources", SOURCES, ["id"], 1),
    }


def stored_ingest_run(
    stores: dict[str, Versions], responses: DataFrame, lexicon: DataFrame, as_of: datetime | str, score=lexicon_scores
) -> dict[str, int]:
    """From recorded feed responses to stored sources and articles. Returns what the run did, also when asked again.

    Counts: responses, failed_responses, items, undated_items, new_sources, new_articles. The articles are written aside
    once, before any table changes, and counted by that job. ``as_of`` names the run, and runs go forward in time: both
    commits carry it, so a run that broke off is called again and adds nothing twice. Ids are digests of url and name, so
    both attempts make the same rows. Sources come first: no stored article lacks its source. One ingestion runs at a time.
    """
    articles, sources = stores["articles"], stores["sources"]
    spark = articles.spark
    run = ("ingestion run", spark.range(1).select(F.unix_micros(at(as_of).cast("timestamp"))).first()[0])
    names = ["responses", "failed_responses", "items", "undated_items", "new_sources", "new_articles"]
    if not articles.has(run):
        raw, raw_counts = materialize_counted(raw_feed(responses), items=F.count("*"))
        known = articles.read().select("url")
        new, counts = materialize_counted(ingest_new_articles(raw, known, lexicon, score), new_articles=F.count("*"))
        if not sources.has(run):
            fresh = new_sources(new.select("source_name"), sources.read().select(*SOURCES.names), as_of)
            fresh, made = materialize_counted(fresh, new_sources=F.count("*"))
            sources.merge(fresh, ["id"], batch=run, notes=made)
        failed = unreadable_responses(responses).count()
        notes = {
            **raw_counts, **counts, "new_sources": sources.snapshot().batches["new_sources"], "responses": responses.count(),
            "failed_responses": failed, "undated_items": undated(clean_feed(raw)).count(),
        }
        rows = with_source_id(new, sources.read().select(*SOURCES.names))
        articles.merge(rows, ["id"], batch=run, notes=notes)
    noted = articles.snapshot().batches
    return {name: noted[name] for name in names}
