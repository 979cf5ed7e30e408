"""The crawl run: status decisions and the chain around them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pressgauge import settings
from pressgauge.functions.text import at, digest_number
from pressgauge.operators.content import content_store, content_upsert
from pressgauge.operators.html_text import extract_text
from pressgauge.operators.ingest import create_crawl_jobs
from pressgauge.operators.politeness import politeness_gate
from pressgauge.operators.reads import article_sentiment_update, pending_jobs
from pressgauge.operators.robots import robots_check
from pressgauge.operators.sentiment import is_blank, lexicon_scores, sentiment_with_fallback
from pressgauge.session import materialize
from pressgauge.sources.events import build_events


def crawl_outcomes(attempts: DataFrame, as_of: datetime | str) -> DataFrame:
    """The ordered status decision for each attempted job.

    ``attempts``: id, article_id, created_at, robots_allowed, robots_reason, polite,
    response_status, response_error, bytes, fetched_at, has_text, processing_error.
    """
    c = F.col
    responded = c("response_status").isNotNull() & (c("response_status") < 400) & c("response_error").isNull()
    # Later rules apply only where no earlier one did.
    forbidden = ~c("robots_allowed")
    limited = ~forbidden & ~c("polite")
    network = ~forbidden & ~limited & ~responded
    broken = ~forbidden & ~limited & ~network & c("processing_error").isNotNull()
    empty = ~forbidden & ~limited & ~network & ~broken & ~c("has_text")
    got_page = ~forbidden & ~limited & ~network
    error = F.coalesce(c("response_error"), F.concat(F.lit("HTTP status "), c("response_status")), F.lit("no response"))
    return attempts.select(
        "id", "article_id",
        F.when(forbidden, "FORBIDDEN_BY_ROBOTS").when(limited, "RATE_LIMITED")
        .when(network | broken | empty, "FAILED").otherwise("SUCCESS").alias("status"),
        "robots_allowed",
        F.when(got_page, c("response_status")).cast("int").alias("http_status"),
        F.when(got_page, c("fetched_at")).alias("fetched_at"),
        F.when(got_page, c("bytes")).alias("bytes_downloaded"),
        F.when(network, "NETWORK_ERROR").when(broken, "PROCESSING_ERROR").alias("error_code"),
        F.when(forbidden, c("robots_reason"))
        .when(limited, settings.MESSAGES["limited"])
        .when(network, F.concat(F.lit(settings.MESSAGES["network"]), error))
        .when(broken, F.concat(F.lit(settings.MESSAGES["processing"]), c("processing_error")))
        .when(empty, settings.MESSAGES["empty"]).alias("error_message"),
        "created_at", at(as_of).alias("updated_at"),
    )


def newest_responses(fetches: DataFrame) -> DataFrame:
    """One recorded response for each url: the last one asked for. Picked on narrow columns, without the html."""
    size = F.octet_length("html").cast("long")
    seen = fetches.select("url", F.struct("requested_at", "response_status", "response_error", size.alias("bytes")).alias("r"))
    return seen.groupBy("url").agg(F.max("r").alias("r")).select("url", "r.*")


def attempt(
    jobs: DataFrame, articles: DataFrame, fetches: DataFrame, snapshots: DataFrame,
    user_agent: str = settings.USER_AGENT,
) -> tuple[DataFrame, DataFrame]:
    """Robots check, politeness and response per job; and the text per article.

    ``fetches`` is the recorded outcome of each request, by url: requested_at,
    response_status (NULL = connection failed), response_error, html; the newest of a url
    counts. The html goes to the text extraction only; everything else runs on narrow rows.
    Job ids are unique over stored and new jobs.
    """
    urls = jobs.select("id", "article_id", "created_at").join(
        articles.select(F.col("id").alias("article_id"), "url"), "article_id"
    )
    checked = robots_check(urls, snapshots, user_agent).select(
        "id", "article_id", "created_at", "url", "domain", F.col("allowed").alias("robots_allowed"),
        F.col("reason").alias("robots_reason"), "crawl_delay",
    )
    # Narrow rows that the gate, the decision and the text branch all start from: computed once.
    asked = materialize(checked.join(newest_responses(fetches), "url", "left"))
    # Any HTTP answer moves the domain's clock, error answers included.
    requests = asked.filter("robots_allowed").select(
        "domain", F.col("id").alias("job_id"), "requested_at", F.col("crawl_delay").alias("delay"),
        F.col("response_status").isNotNull().alias("fetched"),
    )
    gate = politeness_gate(requests).withColumnRenamed("job_id", "id")
    decided = materialize(asked.join(gate, "id", "left").withColumn("polite", F.coalesce("polite", F.lit(False))))
    readable = decided.filter("robots_allowed AND polite AND response_status < 400 AND response_error IS NULL")
    # One page per article, however many of its jobs read it. Written once read, so the sizes of the few
    # pages wanted are known, and other pages' html need not move.
    wanted = materialize(readable.select("article_id", "url", "requested_at").distinct())
    pages = fetches.select("url", "requested_at", "html").join(wanted, ["url", "requested_at"])
    return decided, materialize(extract_text(pages.select("article_id", "html").dropDuplicates(["article_id"]), "article_id"))


def with_text_flag(decided: DataFrame, texts: DataFrame) -> DataFrame:
    """Attempts as ``crawl_outcomes`` reads them. Blank or missing text counts as none."""
    flags = texts.select(
        "article_id", F.coalesce(F.col("text") != "", F.lit(False)).alias("has_text"), F.col("error").alias("processing_error")
    )
    return decided.join(flags, "article_id", "left").withColumns({
        "has_text": F.coalesce("has_text", F.lit(False)), "fetched_at": F.col("requested_at"),
    })


def crawl_run(
    tables: dict[str, DataFrame], fetches: DataFrame, snapshots: DataFrame, lexicon: DataFrame,
    as_of: datetime | str, max_new_jobs: int | None = settings.NEW_JOBS_PER_RUN,
    max_jobs: int | None = settings.JOBS_PER_RUN, user_agent: str = settings.USER_AGENT,
    requeue_rate_limited: bool = False, provider: str = settings.LEXICON_PROVIDER, model_scores: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One worker run over the stored tables; returns the frames to write.

    Keys: new_jobs, outcomes, contents (table after upsert), analyses (new rows),
    articles (table after update), events (new rows). ``None`` limits mean all.
    ``provider`` scores the texts; the model's answers come as ``model_scores``
    (article_id, score, magnitude), texts it did not answer fall back to the lexicon.
    """
    articles, jobs = tables["articles"], tables["crawl_jobs"]
    new_jobs = materialize(create_crawl_jobs(articles, jobs, as_of, max_new_jobs))
    queue = jobs.unionByName(new_jobs)
    if requeue_rate_limited:
        queue = queue.withColumn("status", F.when(F.col("status") == "RATE_LIMITED", "PENDING").otherwise(F.col("status")))
    picked = materialize(pending_jobs(queue, max_jobs))
    results = work_off(
        picked, articles, fetches, snapshots, lexicon, as_of, user_agent, provider, model_scores
    )
    return {
        "new_jobs": new_jobs,
        "outcomes": results["outcomes"],
        "contents": content_upsert(tables["article_contents"], results["contents"]),
        "analyses": results["analyses"],
        "articles": article_sentiment_update(articles, results["analyses"]),
        "events": results["events"],
    }


def work_off(
    picked: DataFrame, articles: DataFrame, fetches: DataFrame, snapshots: DataFrame, lexicon: DataFrame,
    as_of: datetime | str, user_agent: str = settings.USER_AGENT, provider: str = settings.LEXICON_PROVIDER,
    model_scores: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What trying the picked jobs gives: outcomes by job, contents and analyses by article, events. All are new rows."""
    decided, texts = attempt(picked, articles, fetches, snapshots, user_agent)
    outcomes = crawl_outcomes(with_text_flag(decided, texts), as_of)

    whole = texts.filter("text <> ''").select("article_id", "text", at(as_of).alias("extracted_at"))
    flags = whole.select("article_id", is_blank(F.col("text")).alias("blank"), F.char_length("text").cast("long").alias("content_length"))
    scored = lexicon_scores(whole, "article_id", "text", lexicon).join(flags.drop("content_length"), "article_id")
    if model_scores is None:
        model_scores = flags.select("article_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("magnitude")).filter("false")
    answers = sentiment_with_fallback(scored, model_scores, "article_id", provider)
    model = F.create_map(*[F.lit(x) for p in settings.PROVIDERS for x in (p[0], p[3])])
    analyses = answers.select(
        digest_number(F.col("article_id"), F.col("provider_used"), at(as_of)).alias("id"), "article_id",
        F.col("provider_used").alias("provider"), F.try_element_at(model, F.col("provider_used")).alias("model_name"),
        "score", "magnitude", "label", F.lit(settings.DEFAULT_LANGUAGE).alias("language"), at(as_of).alias("analyzed_at"),
    )
    return {
        "outcomes": outcomes,
        "contents": content_store(whole),
        "analyses": analyses,
        "events": build_events(analyses.join(flags.drop("blank"), "article_id"), articles, as_of),
    }
