"""The registered queries: (spark, sf_dir) to a DataFrame.

Instants leave as TIMESTAMP_NTZ, days and lists as text, so results compare
column by column with the SQL in ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge import settings
from pressgauge.functions.text import canonical_url, digest_number, parse_iso, robots_url, url_domain
from pressgauge.operators import (
    analytics, content, crawl, crawl_stored, html_text, ingest, ingest_stored, normalize, politeness, reads, retention, robots, sentiment, validate,
)
from pressgauge.plans import views as V
from pressgauge.session import work_path
from pressgauge.sources import events as event_log, feeds, tables
from pressgauge.sources.versions import Versions
from pressgauge.streaming import stateful, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.raw_feed(V.responses(spark, sf_dir))


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# --- scans, sources, sinks -------------------------------------------------------


@query
def raw_feed_scan(spark, sf_dir):
    return _raw(spark, sf_dir)


@query
def multi_source_union(spark, sf_dir):
    """One batch per language; two of them lack columns."""
    raw = _raw(spark, sf_dir)
    batches = [
        raw.filter("language = 'en'"),
        raw.filter("language = 'de'").drop("image"),
        raw.filter("language = 'fr'").drop("category", "image_url"),
        raw.filter("language IS NULL OR language NOT IN ('en', 'de', 'fr')"),
    ]
    return feeds.union_feeds(batches)


@query
def unreadable_responses(spark, sf_dir):
    """The failed sources of a run: in every five responses one is an error object, one is empty and one never came."""
    broken = V.responses(spark, sf_dir).withColumn("payload", F.expr(
        "CASE payload_seq div 1000 % 5 WHEN 0 THEN '{\"error\": {\"code\": 429}}' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE payload END"
    ))
    return feeds.unreadable_responses(broken).select("payload_seq", "source_name")


@query
def feed_selection(spark, sf_dir):
    picked = feeds.select_feed(_raw(spark, sf_dir), "2024-01-05")
    return picked.select("ingest_seq", "source_name", "category", "language", "published", "rank")


@query
def source_dim(spark, sf_dir):
    """The configured sources with the stored articles of the source in the same position."""
    counts = V.articles(spark, sf_dir).groupBy(F.col("source_id").cast("int").alias("position")).agg(F.count("*").alias("n"))
    return feeds.source_dim(spark).join(counts, "position", "left").select(
        "position", "name", F.coalesce("n", F.lit(0)).alias("n_articles")
    )


@query
def list_sources(spark, sf_dir):
    return V.sources(spark, sf_dir).select("id", "name")


@query
def page_scan(spark, sf_dir):
    return tables.page_scan(
        V.table(spark, sf_dir, "pages"),
        V.fetches(spark, sf_dir).select("page_id", "response_status", F.col("requested_at").alias("fetched_at")),
    )


EVENT_COLUMNS = [
    "event_id", "article_id", "article_url", "article_title", "source_name", "published_at", "ingested_at",
    "sentiment_provider", "sentiment_model", "sentiment_score", "sentiment_magnitude", "sentiment_label",
    "confidence", "language", "country", "category", "content_length", "processing_time_ms", "extraction_method",
]


@query
def sentiment_events_build(spark, sf_dir):
    built = event_log.build_events(V.analyses(spark, sf_dir), V.articles(spark, sf_dir))
    return built.select(*EVENT_COLUMNS)


@query
def sentiment_events_sink(spark, sf_dir):
    """Append the events to a fresh log and read it back."""
    path = work_path(spark, "events")
    event_log.append_events(V.sentiment_events(spark, sf_dir), path)
    return event_log.read_events(spark, path).select(*EVENT_COLUMNS, _day("ingested_date"))


def _catalog(spark, sf_dir):
    found = V.feed_items(spark, sf_dir).selectExpr(
        "concat(language, '-', source_name) AS code", "concat('Agency ', source_name, ', \"', language, '\"') AS name",
        "category", "country", "language", "concat('https://', source_name, '.example.org/', doc_id) AS url", "doc_id AS seq",
    )
    return feeds.source_catalog(found)


@query
def source_catalog(spark, sf_dir):
    path = work_path(spark, "catalog")
    feeds.write_catalog(_catalog(spark, sf_dir), path)
    return feeds.read_catalog(spark, path)


# --- normalise and ingest --------------------------------------------------------


@query
def normalize_required_fields(spark, sf_dir):
    return normalize.clean_feed(_raw(spark, sf_dir)).select("ingest_seq", "title", "description", "url")


@query
def canonical_url_of_pages(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))


QUERIES["canonical_url"] = QUERIES.pop("canonical_url_of_pages")


@query
def parse_published_at(spark, sf_dir):
    return _raw(spark, sf_dir).select("ingest_seq", "published_at", parse_iso(F.col("published_at")).alias("instant"))


@query
def dedup_feed(spark, sf_dir):
    return normalize.dedup_feed(normalize.clean_feed(_raw(spark, sf_dir)))


@query
def normalize_articles(spark, sf_dir):
    return normalize.normalize_articles(_raw(spark, sf_dir), V.lexicon(spark, sf_dir))


@query
def ingest_new_articles(spark, sf_dir):
    return ingest.ingest_new_articles(_raw(spark, sf_dir), V.stored_urls(spark, sf_dir), V.lexicon(spark, sf_dir))


@query
def ingest_articles(spark, sf_dir):
    """The whole insert: sources resolved or created, articles appended and read back with all their columns."""
    path = work_path(spark, "articles")
    new, _ = ingest.ingest(
        _raw(spark, sf_dir), V.stored_urls(spark, sf_dir), V.sources(spark, sf_dir), V.lexicon(spark, sf_dir), V.AS_OF
    )
    tables.append(new, "articles", path)
    return spark.read.parquet(path).drop("published_date")


def _stored_ingestion(spark, sf_dir):
    """The ingestion run on stored tables, asked for twice: the second call finds it done."""
    stores = ingest_stored.open_tables(spark, work_path(spark, "ingestion"))
    stores["sources"].append(V.sources(spark, sf_dir))
    known = V.stored_urls(spark, sf_dir).select(
        digest_number(F.col("url")).alias("id"), F.lit(0).cast("long").alias("source_id"), F.lit("stored").alias("title"), "url",
        F.lit(V.AS_OF).cast("timestamp_ntz").alias("published_at"),
    )
    for field in stores["articles"].schema.fields:
        if field.name not in known.columns:
            known = known.withColumn(field.name, F.lit(None).cast(field.dataType))
    stores["articles"].append(known)
    for _ in range(2):
        counts = ingest_stored.stored_ingest_run(stores, V.responses(spark, sf_dir), V.lexicon(spark, sf_dir), V.AS_OF)
    return stores, counts


@query
def ingest_run_stored(spark, sf_dir):
    """The articles that a stored ingestion run adds."""
    stores, _ = _stored_ingestion(spark, sf_dir)
    return stores["articles"].read().where("title <> 'stored'").drop("bucket")


@query
def ingest_run_counts(spark, sf_dir):
    """What the stored ingestion run says it did, beside the stored rows."""
    stores, counts = _stored_ingestion(spark, sf_dir)
    total = stores["articles"].read().agg(F.count("*").alias("stored_articles"))
    return total.select("stored_articles", *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


@query
def quarantined_dates(spark, sf_dir):
    return ingest.undated(normalize.clean_feed(_raw(spark, sf_dir))).select("ingest_seq", "source_name", "url")


@query
def upsert_sources(spark, sf_dir):
    """The source names after the upsert, with the requests that were rejected as existing."""
    wanted, stored = V.requested_sources(spark, sf_dir), V.sources(spark, sf_dir)
    after = ingest.upsert_sources(wanted, stored, V.AS_OF).select("name", F.lit("stored").alias("outcome"))
    rejected = ingest.rejected_sources(wanted, stored).select(F.col("source_name").alias("name"), F.lit("rejected").alias("outcome"))
    return after.unionByName(rejected)


@query
def validate_articles(spark, sf_dir):
    checked = validate.validate_articles(V.articles(spark, sf_dir))
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


@query
def validate_sources(spark, sf_dir):
    checked = validate.validate_sources(V.requested_sources(spark, sf_dir).withColumnRenamed("source_name", "name"))
    return checked.select("name", "normalized", F.array_join("violations", ",").alias("violations"))


# --- reads -----------------------------------------------------------------------


@query
def article_by_id(spark, sf_dir):
    return reads.article_by_id(V.articles(spark, sf_dir), 42).select("id", "title", "url", "published_at", "sentiment_label")


@query
def article_read(spark, sf_dir):
    rows = reads.article_read(V.articles(spark, sf_dir), V.sources(spark, sf_dir))
    return rows.select("*", F.col("source.id").alias("source_id"), F.col("source.name").alias("source_name")).drop("source")


@query
def latest_articles(spark, sf_dir):
    top = reads.latest_articles(V.articles(spark, sf_dir).drop("source_name"), 20)
    rows = reads.with_source(top, V.sources(spark, sf_dir))
    return rows.select("id", "title", "url", "published_at", F.col("source.name").alias("source_name"))


@query
def latest_with_analyses(spark, sf_dir):
    rows = reads.latest_with_analyses(
        V.articles(spark, sf_dir).drop("source_name"), V.sources(spark, sf_dir), V.analyses(spark, sf_dir), 40
    )
    return rows.select(
        "id", "title", "published_at", F.col("source.name").alias("source_name"),
        "analysis_id", "provider", "score", "magnitude", "label",
    )


@query
def pending_jobs(spark, sf_dir):
    return reads.pending_jobs(V.crawl_jobs(spark, sf_dir), 10).select("id", "article_id", "status", "created_at")


@query
def user_bookmarks(spark, sf_dir):
    rows = reads.user_bookmarks(V.bookmarks(spark, sf_dir), V.articles(spark, sf_dir), 7)
    return rows.select("id", "user_id", "article_id", "title", "url")


@query
def sources_with_articles(spark, sf_dir):
    rows = reads.sources_with_articles(V.sources(spark, sf_dir), V.articles(spark, sf_dir), per_row=50)
    return rows.withColumn("article_ids", F.array_join("article_ids", ","))


@query
def users_with_bookmarks(spark, sf_dir):
    users = V.table(spark, sf_dir, "events").select("user_id").distinct().selectExpr(
        "user_id AS id", "concat('user', user_id, '@example.org') AS email"
    )
    rows = reads.users_with_bookmarks(users, V.bookmarks(spark, sf_dir))
    return rows.withColumn("bookmarks", F.array_join("bookmarks", ","))


@query
def latest_sentiment(spark, sf_dir):
    return reads.latest_sentiment(V.analyses(spark, sf_dir))


@query
def article_sentiment_update(spark, sf_dir):
    rows = reads.article_sentiment_update(V.articles(spark, sf_dir), V.analyses(spark, sf_dir))
    return rows.select("id", "url", "sentiment_label", "sentiment_score")


# --- content, retention ----------------------------------------------------------


def _contents(spark, sf_dir):
    return content.content_store(V.texts(spark, sf_dir))


@query
def content_store(spark, sf_dir):
    return _contents(spark, sf_dir)


def _again(spark, sf_dir):
    """Labelled documents are extracted again a day later."""
    again = V.texts(spark, sf_dir).join(
        V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi"
    ).withColumns({"text": F.concat("text", F.lit(" [updated]")), "extracted_at": F.col("extracted_at") + F.expr("INTERVAL 24 HOURS")})
    return content.content_store(again)


@query
def content_upsert(spark, sf_dir):
    """Labelled documents are extracted again a day later; the rest of the table stays."""
    after = content.content_upsert(_contents(spark, sf_dir), _again(spark, sf_dir))
    return after.select("article_id", "content_hash", "content_length", "extracted_at", "expires_at")


@query
def ttl_split(spark, sf_dir):
    return content.ttl_split(_contents(spark, sf_dir), V.AS_OF).select("article_id", "expires_at", "expired")


@query
def ttl_cleanup(spark, sf_dir):
    return content.ttl_cleanup(_contents(spark, sf_dir), V.AS_OF).select("article_id", "content_hash", "expires_at")


@query
def content_statistics(spark, sf_dir):
    return content.content_statistics(_contents(spark, sf_dir), V.AS_OF)


@query
def content_cleanup_report(spark, sf_dir):
    return content.content_cleanup_report(_contents(spark, sf_dir), V.AS_OF)


@query
def old_crawl_jobs(spark, sf_dir):
    return retention.old_crawl_jobs(V.crawl_jobs(spark, sf_dir), V.AS_OF).select("id", "status", "created_at")


@query
def crawl_job_retention(spark, sf_dir):
    return retention.crawl_job_retention(V.crawl_jobs(spark, sf_dir), V.AS_OF).select("id", "status", "created_at")


@query
def retention_write_back(spark, sf_dir):
    """Both tables stored by days, cleaned up in place and read back: what is left of each."""
    stored, paths = {}, {}
    for name, rows in (("article_contents", _contents(spark, sf_dir)), ("crawl_jobs", V.crawl_jobs(spark, sf_dir))):
        paths[name] = work_path(spark, name)
        tables.create_days(rows, name, paths[name])
        stored[name] = tables.read_days(spark, name, paths[name], rows.schema)

    def sink(name):
        def store(kept, days):
            schema = stored[name].drop(tables.day_column(name)).schema
            tables.replace_days(spark, kept, days, name, paths[name])
            return tables.read_days(spark, name, paths[name], schema)

        return store

    others = {n: V.stored_tables(spark, sf_dir)[n] for n in ("sources", "articles", "sentiment_analyses")}
    report = analytics.run_cleanup({**others, **stored}, V.AS_OF, {n: sink(n) for n in paths})
    if failed := [k for k in report if k.endswith("_error")]:
        raise RuntimeError(str({k: report[k] for k in failed}))
    key = {"article_contents": "article_id", "crawl_jobs": "id"}
    left = [
        tables.read_days(spark, n, paths[n], stored[n].drop(tables.day_column(n)).schema).select(F.lit(n).alias("table_name"), F.col(key[n]).alias("id"))
        for n in paths
    ]
    return left[0].unionByName(left[1])


@query
def cascade_delete(spark, sf_dir):
    """Drop the sources whose name sorts below 'src12' and the labelled toxic articles; what each table keeps."""
    stored = V.stored_tables(spark, sf_dir)
    doomed_sources = stored["sources"].filter("name < 'src12'").select("id")
    doomed_articles = V.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    after = retention.cascade_delete(stored, doomed_sources, doomed_articles)
    parts = [
        df.select(F.lit(name).alias("table_name"), F.col("id")) for name, df in after.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _asked_deletes(spark, sf_dir):
    return V.table(spark, sf_dir, "events").filter("value > 20").selectExpr(
        "event_id AS id", "CASE WHEN value > 60 THEN 0 ELSE user_id END AS user_id"
    )


@query
def bookmark_deletes(spark, sf_dir):
    """Every user asks to delete the bookmark numbered like each of their costly purchases, and one of user 0's."""
    return retention.bookmark_deletes(V.bookmarks(spark, sf_dir), _asked_deletes(spark, sf_dir))


# --- analytics -------------------------------------------------------------------


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def sentiment_trends(spark, sf_dir):
    rows = analytics.sentiment_trends(V.sentiment_events(spark, sf_dir), V.AS_OF)
    return _rounded(rows.withColumn("date", _day("date")), "avg_sentiment_score", "avg_magnitude")


@query
def sentiment_trends_by_source(spark, sf_dir):
    rows = analytics.sentiment_trends(V.sentiment_events(spark, sf_dir), V.AS_OF, 14, "src7")
    return _rounded(rows.withColumn("date", _day("date")), "avg_sentiment_score", "avg_magnitude")


@query
def source_sentiment_comparison(spark, sf_dir):
    return _rounded(analytics.source_sentiment_comparison(V.sentiment_events(spark, sf_dir), V.AS_OF), "avg_sentiment_score")


@query
def database_stats(spark, sf_dir):
    return analytics.database_stats(V.stored_tables(spark, sf_dir))


@query
def crawl_status_breakdown(spark, sf_dir):
    return analytics.crawl_status_breakdown(V.crawl_jobs(spark, sf_dir))


@query
def articles_last_24h(spark, sf_dir):
    return analytics.articles_last_24h(V.articles(spark, sf_dir), V.AS_OF)


@query
def cleanup_report(spark, sf_dir):
    return analytics.cleanup_report(V.stored_tables(spark, sf_dir), V.AS_OF)


# --- sentiment -------------------------------------------------------------------


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """The table may be one file that a scan cannot split; the session's number of partitions deals its texts out."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _doc_scores(spark, sf_dir, method=sentiment.lexicon_scores):
    docs = _dealt(V.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return method(docs, "doc_id", "text", V.lexicon(spark, sf_dir))


@query
def lexicon_sentiment(spark, sf_dir):
    return _doc_scores(spark, sf_dir)


@query
def lexicon_sentiment_plain(spark, sf_dir):
    return _doc_scores(spark, sf_dir, sentiment.lexicon_scores_plain)


@query
def provider_info(spark, sf_dir):
    """Each provider's bounds, model, fallback switch and languages, with the analyses it has made."""
    made = V.analyses(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("n_analyses"))
    return sentiment.providers(spark).join(made, "provider", "left").withColumn("n_analyses", F.coalesce("n_analyses", F.lit(0)))


@query
def label_by_provider(spark, sf_dir):
    scores = V.analyses(spark, sf_dir).selectExpr("id", "lower(provider) AS provider", "score")
    rows = sentiment.label_by_provider(scores, sentiment.providers(spark))
    return rows.select("id", "provider", "score", "label", "positive_threshold", "negative_threshold")


@query
def sentiment_with_fallback(spark, sf_dir):
    """Model scores exist for the labelled documents only."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", sentiment.is_blank(F.col("text")).alias("blank"))
    scored = docs.join(_doc_scores(spark, sf_dir), "doc_id")
    model = V.table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "CAST(quality - toxic AS DOUBLE) / 2 AS score", "CAST(quality + toxic AS DOUBLE) AS magnitude"
    )
    return sentiment.sentiment_with_fallback(scored, model, "doc_id")


# --- crawl -----------------------------------------------------------------------


@query
def url_domain_of_pages(spark, sf_dir):
    domain = url_domain(F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), robots_url(domain).alias("robots_url"))


QUERIES["url_domain"] = QUERIES.pop("url_domain_of_pages")


@query
def articles_without_jobs(spark, sf_dir):
    return ingest.articles_without_jobs(V.articles(spark, sf_dir), V.crawl_jobs(spark, sf_dir), settings.NEW_JOBS_PER_RUN).select("id", "url")


@query
def create_crawl_jobs(spark, sf_dir):
    rows = ingest.create_crawl_jobs(V.articles(spark, sf_dir), V.crawl_jobs(spark, sf_dir), V.AS_OF)
    return rows.select("id", "article_id", "status", "created_at", "updated_at")


@query
def robots_snapshot(spark, sf_dir):
    return robots.robots_snapshot(V.robots_files(spark, sf_dir), V.AS_OF).select("domain", "http_status", "fetched_at", "fresh")


@query
def robots_refetch(spark, sf_dir):
    return robots.refetch_list(V.robots_files(spark, sf_dir), V.table(spark, sf_dir, "pages"), V.AS_OF)


@query
def robots_rules(spark, sf_dir):
    """The groups of the fresh files, one row per rule."""
    groups = robots.robots_rules(robots.fresh_robots(V.robots_files(spark, sf_dir), V.AS_OF))
    return groups.select("domain", "group_no", "is_default", "applies", "crawl_delay", F.posexplode("rules").alias("rule_no", "r")).select(
        "domain", F.col("group_no").cast("int").alias("group_no"), "is_default", "applies", "crawl_delay", "rule_no",
        F.col("r.allow").alias("allow"), F.col("r.path").alias("path"),
    )


def _checked(spark, sf_dir):
    urls = V.fetches(spark, sf_dir).select("page_id", "url", "requested_at", "response_status")
    return robots.robots_check(urls, robots.fresh_robots(V.robots_files(spark, sf_dir), V.AS_OF))


@query
def robots_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("page_id", "domain", "allowed", "reason", "crawl_delay")


@query
def robots_check_long(spark, sf_dir):
    """Files whose rules grow with the pages, looked up by prefix."""
    urls = V.table(spark, sf_dir, "pages").select("page_id", "url")
    checked = robots.robots_check(urls, V.long_robots_files(spark, sf_dir), rules_in_row=3)
    return checked.select("page_id", "domain", "allowed", "reason")


def _requests(events: DataFrame) -> DataFrame:
    """Each user is a domain asking at its events' times, one to five hours apart; errors get no response."""
    return events.selectExpr(
        "concat('host', user_id) AS domain", "event_id AS job_id", "ts AS requested_at",
        "3600.0D * (1 + user_id % 5) AS delay", "event_type <> 'error' AS fetched",
    )


@query
def politeness_gate(spark, sf_dir):
    return politeness.politeness_gate(_requests(V.table(spark, sf_dir, "events")))


@query
def politeness_gate_short(spark, sf_dir):
    """Delays of one to five seconds in slices of 64: many slices and clocks."""
    quick = _requests(V.table(spark, sf_dir, "events")).withColumn("delay", F.col("delay") / 3600)
    return politeness.politeness_gate(quick, 64)


@query
def extract_text(spark, sf_dir):
    return html_text.extract_text(_dealt(V.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id"))


def _run(spark, sf_dir):
    articles = V.page_articles(spark, sf_dir)
    stored = {
        "articles": articles,
        "crawl_jobs": V.crawl_jobs(spark, sf_dir),
        "article_contents": _contents(spark, sf_dir),
    }
    files = robots.fresh_robots(V.robots_files(spark, sf_dir), V.AS_OF)
    return crawl.crawl_run(stored, V.fetches(spark, sf_dir), files, V.lexicon(spark, sf_dir), V.AS_OF, None, None)


@query
def crawl_outcomes(spark, sf_dir):
    return _run(spark, sf_dir)["outcomes"].drop("created_at", "updated_at")


@query
def crawl_run(spark, sf_dir):
    """The events a whole run emits."""
    return _run(spark, sf_dir)["events"].select(
        "event_id", "article_id", "article_url", "source_name", "sentiment_score", "sentiment_label", "content_length"
    )


def _stored_run(spark, sf_dir):
    """The run of ``_run`` on stored tables, asked for twice: the second call finds it done."""
    root = work_path(spark, "crawl")
    stores = crawl_stored.open_tables(spark, root)
    stores["articles"].append(V.page_articles(spark, sf_dir))
    stores["crawl_jobs"].append(V.crawl_jobs(spark, sf_dir))
    stores["article_contents"].append(_contents(spark, sf_dir))
    # Articles of pages have the sources src0, src1, ...
    names = V.page_articles(spark, sf_dir).selectExpr("source_id AS id", "source_name AS name").distinct()
    files = robots.fresh_robots(V.robots_files(spark, sf_dir), V.AS_OF)
    for _ in range(2):
        counts = crawl_stored.stored_crawl_run(
            stores, names, f"{root}/events", V.fetches(spark, sf_dir), files, V.lexicon(spark, sf_dir), V.AS_OF, None, None
        )
    return stores, f"{root}/events", counts


@query
def crawl_jobs_stored(spark, sf_dir):
    """The stored jobs after a run: outcomes in place of the tried ones, all others as they were."""
    stores, _, _ = _stored_run(spark, sf_dir)
    return crawl_stored.stored(stores["crawl_jobs"]).select(
        "id", "article_id", "status", "robots_allowed", "http_status", "fetched_at", "bytes_downloaded", "error_code", "error_message"
    )


@query
def crawl_events_stored(spark, sf_dir):
    """The event log that a stored run leaves, with all columns."""
    _, path, _ = _stored_run(spark, sf_dir)
    return event_log.read_events(spark, path)


@query
def crawl_run_summary(spark, sf_dir):
    run = _run(spark, sf_dir)
    return analytics.crawl_run_summary(run["outcomes"], run["new_jobs"])


# --- streams ---------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """One driver table as a stream."""
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _response_log(spark, sf_dir):
    """The feed responses as a log of JSON files, the stream's input."""
    log = work_path(spark, "responses")
    V.responses(spark, sf_dir).write.json(log)
    return feeds.stream_responses(spark, log)


@query
def stream_ingest_articles(spark, sf_dir):
    out = work_path(spark, "articles")
    streams.drain(streams.ingest_stream(
        _response_log(spark, sf_dir), V.lexicon(spark, sf_dir), out, work_path(spark, "state"),
        V.stored_urls(spark, sf_dir),
    ))
    return spark.read.parquet(out).drop("batch", "id")


@query
def stream_url_dedup(spark, sf_dir):
    out = work_path(spark, "dedup")
    streams.drain(streams.dedup_stream(_response_log(spark, sf_dir), out, work_path(spark, "state")))
    return streams.first_items(spark, out)


@query
def stream_sentiment_trends(spark, sf_dir):
    out = work_path(spark, "trends")
    events = V.sentiment_events(spark, sf_dir, _stream(spark, sf_dir, "events"))
    streams.drain(streams.trend_stream(events, out, work_path(spark, "state")))
    return _rounded(streams.trend_table(spark, out).withColumn("date", _day("date")), "avg_sentiment_score", "avg_magnitude")


@query
def stream_events_sink(spark, sf_dir):
    out = work_path(spark, "events")
    events = V.sentiment_events(spark, sf_dir, _stream(spark, sf_dir, "events"))
    streams.drain(streams.event_sink_stream(events, out, work_path(spark, "state")))
    return event_log.read_events(spark, out).select(*EVENT_COLUMNS, _day("ingested_date"))


@query
def stream_politeness_gate(spark, sf_dir):
    out = work_path(spark, "gate")
    requests = _requests(_stream(spark, sf_dir, "events"))
    streams.drain(streams.politeness_stream(requests, out, work_path(spark, "state")))
    return streams.politeness_verdicts(spark, out)


@query
def stream_content_expiry(spark, sf_dir):
    """Contents stored by article, and what is left when the same contents have passed the stream of expiries by hours.

    The clock is the newest extraction of all, so this is the cleanup of that instant.
    """
    rows = _contents(spark, sf_dir)
    store = tables.by_article(spark, "article_contents", work_path(spark, "contents"), rows.schema)
    store.append(rows)
    arriving = work_path(spark, "extractions")
    rows.select("article_id", "expires_at").write.parquet(arriving)
    stream = spark.readStream.schema("article_id long, expires_at timestamp_ntz").parquet(arriving)
    streams.drain(stateful.expiry_stream(stream, store, work_path(spark, "state")))
    return store.read().select("article_id", "content_hash", "expires_at")


@query
def content_merge(spark, sf_dir):
    """The content table by buckets of articles after the upsert of ``content_upsert`` was merged into it, with its texts."""
    rows = _contents(spark, sf_dir)
    store = tables.by_article(spark, "article_contents", work_path(spark, "contents"), rows.schema)
    store.append(rows)
    store.merge(_again(spark, sf_dir), ["article_id"])
    store.vacuum(hours=0)
    return store.read().drop("bucket")


@query
def bookmark_deletes_stored(spark, sf_dir):
    """``bookmark_deletes`` on a stored table: only the buckets of asked-for bookmarks are rewritten."""
    rows = V.bookmarks(spark, sf_dir)
    store = Versions.buckets(spark, work_path(spark, "bookmarks"), rows.schema, ["id"])
    store.append(rows)
    store.merge(_asked_deletes(spark, sf_dir), ["id", "user_id"], "delete")
    return store.read().drop("bucket")


@query
def article_sentiment_merge(spark, sf_dir):
    """``article_sentiment_update`` on the stored articles."""
    rows = V.articles(spark, sf_dir).drop("source_name")
    store = Versions.buckets(spark, work_path(spark, "articles"), rows.schema, ["id"])
    store.append(rows)
    newest = reads.latest_sentiment(V.analyses(spark, sf_dir)).selectExpr("article_id AS id", "label AS sentiment_label", "score AS sentiment_score")
    store.merge(newest, ["id"], "update", ["sentiment_label", "sentiment_score"])
    return store.read().select("id", "url", "sentiment_label", "sentiment_score")
