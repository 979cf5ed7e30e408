"""Retention of crawl jobs and keyed deletes down the table graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pressgauge import settings
from pressgauge.functions.text import at, days
from pressgauge.session import materialize


def is_old_job(as_of: datetime | str, days_old: int = settings.JOB_RETENTION_DAYS) -> Column:
    """Terminal and created strictly before the cutoff."""
    return F.col("status").isin(settings.TERMINAL_STATUSES) & (F.col("created_at") < at(as_of) - days(days_old))


def old_crawl_jobs(jobs: DataFrame, as_of: datetime | str, days_old: int = settings.JOB_RETENTION_DAYS) -> DataFrame:
    return jobs.filter(is_old_job(as_of, days_old))


def crawl_job_retention(jobs: DataFrame, as_of: datetime | str, days_old: int = settings.JOB_RETENTION_DAYS) -> DataFrame:
    return jobs.filter(~is_old_job(as_of, days_old))


def crawl_job_report(jobs: DataFrame, as_of: datetime | str, days_old: int = settings.JOB_RETENTION_DAYS) -> DataFrame:
    old = F.count_if(is_old_job(as_of, days_old))
    return jobs.agg(
        old.alias("old_crawl_jobs_deleted"), old.alias("old_crawl_jobs_found"),
        (at(as_of) - days(days_old)).alias("cutoff_date"),
    )


CHILDREN = ["article_contents", "crawl_jobs", "sentiment_analyses", "bookmarks"]


def cascade_delete(
    tables: dict[str, DataFrame], sources: DataFrame | None = None, articles: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The tables after deleting the given source ids and article ids with all they own.

    ``sources`` and ``articles`` are key frames with a column ``id``.
    """
    out = dict(tables)
    doomed = None
    if sources is not None:
        out["sources"] = tables["sources"].join(sources.select("id"), "id", "left_anti")
        owned = sources.select(F.col("id").alias("source_id"))
        doomed = tables["articles"].join(owned, "source_id", "left_semi").select("id")
    if articles is not None:
        keys = articles.select("id")
        doomed = keys if doomed is None else doomed.unionByName(keys).distinct()
    if doomed is None:
        return out
    doomed = materialize(doomed)  # five tables read it
    out["articles"] = tables["articles"].join(doomed, "id", "left_anti")
    child_keys = doomed.select(F.col("id").alias("article_id"))
    for name in CHILDREN:
        if name in tables:
            out[name] = tables[name].join(child_keys, "article_id", "left_anti")
    return out


def bookmark_deletes(bookmarks: DataFrame, requests: DataFrame) -> DataFrame:
    """Bookmarks left after delete requests (id, user_id); somebody else's bookmark stays."""
    return bookmarks.join(requests.select("id", "user_id"), ["id", "user_id"], "left_anti")


def unmatched_deletes(bookmarks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests naming no bookmark of that user."""
    return requests.join(bookmarks.select("id", "user_id"), ["id", "user_id"], "left_anti")
