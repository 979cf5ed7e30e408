"""The crawl run on stored tables: picked jobs are marked, results are written table by table, a replay changes nothing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge import settings
from pressgauge.functions.text import at, hours
from pressgauge.operators.crawl import work_off
from pressgauge.operators.ingest import create_crawl_jobs
from pressgauge.operators.reads import latest_sentiment, pending_jobs
from pressgauge.schemas import ARTICLE_CONTENTS, ARTICLES, CRAWL_JOBS, SENTIMENT_ANALYSES
from pressgauge.session import materialize, materialize_counted
from pressgauge.sources import tables
from pressgauge.sources.events import append_events
from pressgauge.sources.versions import Versions


def open_tables(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, Versions]:
    """The tables that a run changes, as folders of ``root``: by buckets where rows change by key, by days where they are added."""
    return {
        "articles": Versions.buckets(spark, f"{root}/articles", ARTICLES, ["id"], buckets),
        "crawl_jobs": Versions.buckets(spark, f"{root}/crawl_jobs", CRAWL_JOBS, ["id"], buckets),
        "article_contents": tables.by_article(spark, "article_contents", f"{root}/article_contents", ARTICLE_CONTENTS, buckets),
        "sentiment_analyses": tables.by_days(spark, "sentiment_analyses", f"{root}/sentiment_analyses", SENTIMENT_ANALYSES),
    }


def stored(store: Versions) -> DataFrame:
    return store.read().select(*store.schema.names)


def pick(
    stores: dict[str, Versions], as_of: datetime | str, max_new_jobs: int | None, max_jobs: int | None,
    requeue_rate_limited: bool, abandoned_hours: int | None,
) -> tuple[DataFrame, DataFrame]:
    """New jobs, and the jobs to try as IN_PROGRESS. Jobs of articles that are not stored wait.

    Jobs that a run left IN_PROGRESS for ``abandoned_hours`` count as PENDING again.
    """
    articles, jobs = stored(stores["articles"]), stored(stores["crawl_jobs"])
    new_jobs = materialize(create_crawl_jobs(articles, jobs, as_of, max_new_jobs))
    again = F.lit(requeue_rate_limited) & (F.col("status") == "RATE_LIMITED")
    if abandoned_hours is not None:
        again |= (F.col("status") == "IN_PROGRESS") & (F.col("updated_at") <= at(as_of) - hours(abandoned_hours))
    queue = jobs.unionByName(new_jobs).withColumn("status", F.when(again, "PENDING").otherwise(F.col("status")))
    queue = queue.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    picked = pending_jobs(queue, max_jobs).withColumns({"status": F.lit("IN_PROGRESS"), "updated_at": at(as_of)})
    return new_jobs, materialize(picked.select(*CRAWL_JOBS.names))


def stored_crawl_run(
    stores: dict[str, Versions], sources: DataFrame, events_path: str, fetches: DataFrame, snapshots: DataFrame,
    lexicon: DataFrame, as_of: datetime | str, max_new_jobs: int | None = settings.NEW_JOBS_PER_RUN,
    max_jobs: int | None = settings.JOBS_PER_RUN, user_agent: str = settings.USER_AGENT,
    requeue_rate_limited: bool = False, abandoned_hours: int | None = None,
    provider: str = settings.LEXICON_PROVIDER, model_scores: DataFrame | None = None,
) -> dict[str, int]:
    """One run over stored tables. Returns processed, successful, failed and new_jobs_created, counted while writing.

    ``as_of`` names the run, and runs go forward in time. First the new jobs are added and the picked ones become
    IN_PROGRESS, in one commit. Their results are worked out and written aside before any table changes; then contents,
    analyses, articles and the event log follow, and the jobs' outcomes last. Every commit carries the run, so a run that
    broke off is called again with the same ``as_of``: it finds its jobs by their mark, works out the same rows (ids are
    digests) and skips what is committed. After the last commit a call only returns the counts. Of two runs at once, the
    second to mark its jobs gets ``Conflict`` and has changed nothing. The event log is best effort, as in the batch sink.
    """
    spark, jobs = stores["crawl_jobs"].spark, stores["crawl_jobs"]
    number = spark.range(1).select(F.unix_micros(at(as_of).cast("timestamp"))).first()[0]
    start, end = ("crawl run started", number), ("crawl run", number)
    names = ["processed", "successful", "failed", "new_jobs_created"]
    if not jobs.has(start):
        new_jobs, picked = pick(stores, as_of, max_new_jobs, max_jobs, requeue_rate_limited, abandoned_hours)
        rest = new_jobs.join(picked.select("id"), "id", "left_anti").select(*CRAWL_JOBS.names)
        changes, made = materialize_counted(
            rest.unionByName(picked), new=F.count_if(F.col("created_at") == at(as_of))
        )
        jobs.merge(changes, ["id"], batch=start, notes={"new_jobs_created": made["new"]})
    if not jobs.has(end):
        mine = stored(jobs).filter((F.col("status") == "IN_PROGRESS") & (F.col("updated_at") == at(as_of)))
        dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
        articles = stored(stores["articles"]).join(dim, "source_id", "left")
        results = work_off(mine, articles, fetches, snapshots, lexicon, as_of, user_agent, provider, model_scores)
        good = F.count_if(F.col("status") == "SUCCESS")
        outcomes, counts = materialize_counted(results["outcomes"], processed=F.count("*"), successful=good)
        contents, analyses, events = (materialize(results[k]) for k in ("contents", "analyses", "events"))

        stores["article_contents"].merge(contents, ["article_id"], batch=end)
        stores["sentiment_analyses"].append(analyses, batch=end)
        newest = latest_sentiment(analyses).selectExpr("article_id AS id", "label AS sentiment_label", "score AS sentiment_score")
        stores["articles"].merge(newest, ["id"], "update", ["sentiment_label", "sentiment_score"], batch=end)
        append_events(events, events_path)
        jobs.merge(outcomes, ["id"], batch=end, notes={**counts, "failed": counts["processed"] - counts["successful"]})
    noted = jobs.snapshot().batches
    return {name: noted[name] for name in names}
