"""Aggregates over the event log and the stored tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgauge import settings
from pressgauge.functions.text import at, days, hours
from pressgauge.operators import content, retention
from pressgauge.session import materialize


def recent_events(events: DataFrame, as_of: datetime | str, n_days: int) -> DataFrame:
    """Events since the cutoff (inclusive). The day column, where present, prunes folders."""
    cutoff = at(as_of) - days(n_days)
    rows = events.filter(F.col("ingested_at") >= cutoff)
    if "ingested_date" in events.columns:
        rows = rows.filter(F.col("ingested_date") >= F.to_date(cutoff))
    return rows


def sentiment_trends(
    events: DataFrame, as_of: datetime | str, n_days: int = settings.TREND_DAYS, source: str | None = None
) -> DataFrame:
    rows = recent_events(events, as_of, n_days)
    if source:
        rows = rows.filter(F.col("source_name") == source)
    return (
        rows.groupBy(F.to_date("ingested_at").alias("date"), "sentiment_label")
        .agg(
            F.count("*").alias("article_count"), F.avg("sentiment_score").alias("avg_sentiment_score"),
            F.avg("sentiment_magnitude").alias("avg_magnitude"),
        )
        .orderBy(F.desc("date"), "sentiment_label")
    )


def source_sentiment_comparison(events: DataFrame, as_of: datetime | str, n_days: int = settings.TREND_DAYS) -> DataFrame:
    """Per source and label: count, mean score, share within the source. The window sees aggregated rows only."""
    per_label = (
        recent_events(events, as_of, n_days).filter("source_name IS NOT NULL")
        .groupBy("source_name", "sentiment_label")
        .agg(F.count("*").alias("article_count"), F.avg("sentiment_score").alias("avg_sentiment_score"))
    )
    of_source = F.sum("article_count").over(Window.partitionBy("source_name"))
    return per_label.withColumn("percentage", F.round(F.col("article_count") * 100.0 / of_source, 2)).orderBy(
        "source_name", "sentiment_label"
    )


STAT_TABLES = ["sources", "articles", "article_contents", "crawl_jobs", "sentiment_analyses"]


def database_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: statistic, value."""
    counts = [
        tables[name].agg(F.count("*").alias("value")).select(F.lit(f"{name}_count").alias("statistic"), "value")
        for name in STAT_TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def crawl_status_breakdown(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def articles_last_24h(articles: DataFrame, as_of: datetime | str) -> DataFrame:
    return articles.filter(F.col("published_at") >= at(as_of) - hours(24)).agg(F.count("*").alias("articles_last_24h"))


def crawl_run_summary(outcomes: DataFrame, new_jobs: DataFrame) -> DataFrame:
    """processed, successful, failed, new_jobs_created."""
    rows = outcomes.select("status", F.lit(0).alias("made")).unionByName(new_jobs.select(F.lit(None).cast("string").alias("status"), F.lit(1).alias("made")))
    done = F.count_if(F.col("made") == 0)
    successful = F.count_if(F.col("status") == "SUCCESS")
    return rows.agg(
        done.alias("processed"), successful.alias("successful"), (done - successful).alias("failed"),
        F.count_if(F.col("made") == 1).alias("new_jobs_created"),
    )


def _rows(section: str, df: DataFrame, names: list[str]) -> DataFrame:
    """A one-row frame as (section, statistic, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("string").alias("value")) for n in names])
    return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.statistic", "p.value")


def cleanup_report(
    tables: dict[str, DataFrame], as_of: datetime | str, days_old: int = settings.JOB_RETENTION_DAYS
) -> DataFrame:
    """Content cleanup, job retention and the statistics afterwards, as (section, statistic, value)."""
    contents, jobs = tables["article_contents"], tables["crawl_jobs"]
    after = {
        **tables,
        "article_contents": content.ttl_cleanup(contents, as_of),
        "crawl_jobs": retention.crawl_job_retention(jobs, as_of, days_old),
    }
    stats = database_stats(after).select(F.lit("database_stats").alias("section"), "statistic", F.col("value").cast("string").alias("value"))
    status = crawl_status_breakdown(after["crawl_jobs"]).select(
        F.lit("crawl_job_status").alias("section"), F.col("status").alias("statistic"), F.col("jobs").cast("string").alias("value")
    )
    parts = [
        _rows("content_cleanup", content.content_cleanup_report(contents, as_of),
              ["expired_content_deleted", "expired_content_found", "total_content_remaining"]),
        _rows("crawl_job_cleanup", retention.crawl_job_report(jobs, as_of, days_old),
              ["old_crawl_jobs_deleted", "old_crawl_jobs_found"]),
        stats,
        status,
        _rows("database_stats", articles_last_24h(tables["articles"], as_of), ["articles_last_24h"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def touched_days(rows: DataFrame, gone: Column, instant: str) -> DataFrame:
    """The days that lose rows: what a write-back must replace."""
    return rows.filter(gone).select(F.to_date(instant).alias("day")).distinct()


def run_cleanup(tables: dict[str, DataFrame], as_of: datetime | str, sinks: dict) -> dict:
    """Run each cleanup part on its own: one failing part is reported, the others still run.

    ``sinks`` maps "article_contents" / "crawl_jobs" to a function (kept rows of the days
    that lose some, those days) that stores them and returns the table as it is then. Each
    part counts before it deletes; the statistics are of the tables afterwards.
    """
    after = dict(tables)

    def part(name: str, report: DataFrame, gone: Column, instant: str):
        def run() -> dict:
            rows = tables[name]
            counted = report.first().asDict()
            days = materialize(touched_days(rows, gone, instant))
            kept = rows.filter(~gone).join(days, F.to_date(instant) == F.col("day"), "left_semi")
            after[name] = sinks[name](kept, days)
            return counted

        return run

    contents, jobs = tables["article_contents"], tables["crawl_jobs"]
    parts = {
        "content_cleanup": part("article_contents", content.content_cleanup_report(contents, as_of), content.is_expired(as_of), "expires_at"),
        "crawl_job_cleanup": part("crawl_jobs", retention.crawl_job_report(jobs, as_of), retention.is_old_job(as_of), "created_at"),
        "database_stats": lambda: {r.statistic: r.value for r in database_stats(after).collect()},
    }
    report: dict = {}
    for name, run in parts.items():
        try:
            report[name] = run()
        except Exception as error:
            report[f"{name}_error"] = str(error)
    return report
