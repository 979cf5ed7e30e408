"""The engine's tables derived from the driver's tables.

Each view is a plain projection or join over whole tables. ``sql.py`` holds the
same derivations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge.operators.sentiment import DEFAULT_WORDS
from pressgauge.session import prepare

AS_OF = "2024-01-31 00:00:00"
PAGE_SIZE = 500  # documents per feed response, over all sources
START = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"

# Shared by Spark and DuckDB.
FIRST_LINE = "split_part(text, chr(10), 1)"
REST = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"
COUNTRY = "CASE lang WHEN 'en' THEN 'gb' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' ELSE 'es' END"
CATEGORY = (
    "CASE doc_id % 8 WHEN 0 THEN 'general' WHEN 1 THEN 'business' WHEN 2 THEN 'health' WHEN 3 THEN 'science' "
    "WHEN 4 THEN 'technology' WHEN 5 THEN 'sports' WHEN 6 THEN 'entertainment' ELSE 'general' END"
)
# Later documents of each block of 60 repeat the path of earlier ones.
STORY = (
    "(doc_id - doc_id % 60 + CASE WHEN doc_id % 60 >= 40 THEN doc_id % 60 - 40 "
    "WHEN doc_id % 60 >= 30 THEN doc_id % 60 - 30 ELSE doc_id % 60 END)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _instant(hours: str) -> str:
    return f"{START} + make_dt_interval(0, CAST({hours} AS INT))"


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed item per document, as publishers send them: padded, duplicated, odd dates."""
    hour = "(doc_id % 720)"
    published = (
        "CASE WHEN doc_id % 60 = 7 THEN 'soon'"
        f" WHEN doc_id % 4 = 0 THEN date_format({_instant(hour)}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        f" WHEN doc_id % 4 = 1 THEN date_format({_instant(hour + ' + 2')}, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")"
        f" WHEN doc_id % 4 = 2 THEN date_format({_instant(hour)}, \"yyyyMMdd'T'HHmmss'Z'\")"
        f" ELSE date_format({_instant(hour)}, 'yyyy-MM-dd') END"
    )
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS source_name",
        f"concat('  ', {FIRST_LINE}, chr(9)) AS title", f"{REST} AS description",
        f"concat('HTTPS://News.example.org/a/', {STORY}, ';v=1?utm=', doc_id, '#top') AS url",
        f"CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('https://img.example.org/', {STORY}, '.png') END AS image",
        f"concat('https://img.example.org/alt/', {STORY}, '.png') AS image_url",
        f"{published} AS published_at", "source", "lang AS language", f"{COUNTRY} AS country", f"{CATEGORY} AS category",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies: per source and block of 500 documents, so a body is bounded whatever the source's share."""
    items = feed_items(spark, sf_dir)
    item = F.struct("title", "description", "url", "image", "image_url", "published_at", "source", "language", "country", "category")
    grouped = items.groupBy("source_name", F.expr(f"doc_id div {PAGE_SIZE}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("rows")
    )
    return grouped.select(
        F.expr("block * 1000 + CAST(substr(source_name, 4) AS BIGINT)").alias("payload_seq"), "source_name",
        F.to_json(F.struct(F.transform("rows", lambda r: r["item"]).alias("data"))).alias("payload"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles: one per document; labelled documents carry a sentiment."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id", "CAST(substr(source, 4) AS BIGINT) AS source_id", f"{FIRST_LINE} AS title", f"{REST} AS description",
        "concat('https://news.example.org/d/', doc_id) AS url",
        "concat('https://img.example.org/', doc_id, '.png') AS image_url",
        f"{_instant('doc_id % 720')} AS published_at", "lang AS language", f"{COUNTRY} AS country", f"{CATEGORY} AS category",
        "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment_label",
        "CAST(quality - toxic AS DOUBLE) / 2 AS sentiment_score", "source AS source_name",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().selectExpr(
        "CAST(substr(source, 4) AS BIGINT) AS id", "source AS name", f"{START} AS created_at", f"{START} AS updated_at"
    )


def requested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names somebody asks to add: nations, regions and the stored sources."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_name AS source_name")
    region = table(spark, sf_dir, "region").selectExpr("r_name AS source_name")
    known = table(spark, sf_dir, "documents").selectExpr("source AS source_name").distinct()
    return nation.unionByName(region).unionByName(known)


def stored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls stored by earlier runs: the stories that have a labelled document."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled.selectExpr(f"concat('https://News.example.org/a/', {STORY}) AS url").distinct()


LABEL_OF_EVENT = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END"
SCORE_OF_EVENT = (
    "round(CASE WHEN event_type IN ('purchase', 'signup') THEN least(value / 500, 1.0) "
    "WHEN event_type = 'error' THEN -least(value / 500, 1.0) ELSE 0.0 END, 4)"
)


def sentiment_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = events if events is not None else table(spark, sf_dir, "events")
    return events.selectExpr(
        "concat(event_id, '_VADER_', unix_seconds(CAST(ts AS TIMESTAMP))) AS event_id", "user_id AS article_id",
        "concat('https://news.example.org/d/', user_id) AS article_url", "event_type AS article_title",
        "CASE WHEN user_id % 20 <> 0 THEN concat('src', user_id % 20) END AS source_name",
        "ts AS published_at", "ts AS ingested_at", "'VADER' AS sentiment_provider", "'vader_lexicon' AS sentiment_model",
        f"{SCORE_OF_EVENT} AS sentiment_score", "CASE WHEN event_type <> 'error' THEN value END AS sentiment_magnitude",
        f"{LABEL_OF_EVENT} AS sentiment_label", "CAST(NULL AS DOUBLE) AS confidence", "'en' AS language",
        "CAST(NULL AS STRING) AS country", "CAST(NULL AS STRING) AS category", "CAST(length(props) AS BIGINT) AS content_length",
        "CAST(NULL AS BIGINT) AS processing_time_ms", "'web_crawl' AS extraction_method",
    )


JOB_STATUS = (
    "CASE WHEN value > 100 THEN 'IN_PROGRESS' WHEN event_type = 'view' THEN 'PENDING' WHEN event_type = 'click' THEN 'SUCCESS' "
    "WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'purchase' THEN 'FORBIDDEN_BY_ROBOTS' ELSE 'RATE_LIMITED' END"
)


def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS article_id", f"{JOB_STATUS} AS status",
        "event_type <> 'purchase' AS robots_allowed", "CASE WHEN event_type = 'click' THEN 200 END AS http_status",
        "CASE WHEN event_type = 'click' THEN ts END AS fetched_at", "CAST(length(props) AS BIGINT) AS bytes_downloaded",
        "CASE WHEN event_type = 'error' THEN 'NETWORK_ERROR' END AS error_code", "CAST(NULL AS STRING) AS error_message",
        "ts AS created_at", "ts AS updated_at",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted texts: every document, whole."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS article_id", "text", f"{_instant('doc_id % 720')} AS extracted_at"
    )


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase is a bookmark; its value names the article."""
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").selectExpr(
        "event_id AS id", "user_id", "CAST(floor(value) AS BIGINT) AS article_id"
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon analysis per document and a later model analysis per labelled one."""
    docs = table(spark, sf_dir, "documents")
    lexicon = docs.selectExpr(
        "doc_id * 2 AS id", "doc_id AS article_id", "'VADER' AS provider", "'vader_lexicon' AS model_name",
        "round(CAST(n_chars % 2001 AS DOUBLE) / 1000 - 1, 3) AS score", "CAST(NULL AS DOUBLE) AS magnitude",
        f"{_instant('doc_id % 720')} AS analyzed_at",
    )
    model = table(spark, sf_dir, "labels").selectExpr(
        "doc_id * 2 + 1 AS id", "doc_id AS article_id", "'GCP_NL' AS provider", "'gcp_nl_v1' AS model_name",
        "CAST(quality - toxic AS DOUBLE) / 2 AS score", "CAST(quality + toxic AS DOUBLE) AS magnitude",
        f"{_instant('doc_id % 720 + 1')} AS analyzed_at",
    )
    scored = lexicon.unionByName(model)
    bound = "CASE provider WHEN 'VADER' THEN 0.05D ELSE 0.25D END"
    return scored.selectExpr(
        "*", f"CASE WHEN score >= {bound} THEN 'positive' WHEN score <= -{bound} THEN 'negative' ELSE 'neutral' END AS label",
        "'en' AS language",
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our own word list plus the words of the benchmark texts, valued by length."""
    own = spark.createDataFrame(list(DEFAULT_WORDS.items()), "word string, valence double")
    found = table(spark, sf_dir, "benchmark").selectExpr("explode(split(lower(text), '[^a-z]+')) AS word")
    found = found.filter("word <> ''").distinct().join(own.select("word"), "word", "left_anti")
    return own.unionByName(found.selectExpr("word", "CAST(length(word) * 7 % 9 - 4 AS DOUBLE) * 0.5D AS valence"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles waiting to be crawled."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS id", "page_id % 20 AS source_id", "concat('Page ', page_id) AS title", "CAST(NULL AS STRING) AS description",
        "url", "CAST(NULL AS STRING) AS image_url", f"{START} AS published_at", "'en' AS language",
        "CAST(NULL AS STRING) AS country", "CAST(NULL AS STRING) AS category",
        "CAST(NULL AS STRING) AS sentiment_label", "CAST(NULL AS DOUBLE) AS sentiment_score",
        "concat('src', page_id % 20) AS source_name",
    )


RESPONSE_STATUS = "CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' AND value > 50 THEN NULL ELSE 200 END"


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded request of each page: every 20 ms one, answered as the event of the same number says."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    answer = events.selectExpr("event_id AS page_id", f"{RESPONSE_STATUS} AS response_status")
    return pages.join(answer, "page_id", "left").selectExpr(
        "page_id", "url", "html", f"TIMESTAMP_NTZ'{AS_OF}' + make_dt_interval(0, 0, 0, CAST(page_id * 0.02 AS DECIMAL(18, 6))) AS requested_at",
        "response_status", "CASE WHEN response_status IS NULL THEN 'connection reset' END AS response_error",
    )


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two robots snapshots per host of the pages, written from the host's page count and path prefixes."""
    hosts = table(spark, sf_dir, "pages").selectExpr(
        "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain",
        "regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS section",
    ).groupBy("domain").agg(F.count("*").alias("n"), F.min("section").alias("lo"), F.max("section").alias("hi"))
    body = (
        "concat('# robots of ', domain, chr(10), 'User-Agent: *', chr(10), 'Disallow: /', hi, '/1  # numbered', chr(10), "
        "'Allow: /', chr(10), 'Crawl-delay: ', n % 4, chr(10), chr(10), "
        "CASE WHEN domain LIKE '%.org' THEN concat('User-agent: otherbot', chr(10), 'User-agent: PressGauge', chr(10), "
        "'Allow: /', lo, '/1', chr(10), 'disallow: /', lo, '/', chr(10), 'Crawl-delay: 2', chr(10)) ELSE '' END)"
    )
    old = hosts.selectExpr("domain", "200 AS http_status", f"{body} AS body", f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 30 HOURS AS fetched_at")
    new = hosts.selectExpr(
        "domain", "CASE n % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS http_status", f"{body} AS body",
        f"TIMESTAMP_NTZ'{AS_OF}' - make_dt_interval(0, CAST(n % 4 AS INT)) AS fetched_at",
    )
    return old.unionByName(new)


def long_robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per host with three rules for each of its pages: the page's path and two beginnings of it."""
    rules = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain",
        "regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path", "explode(sequence(0, 2)) AS k",
    ).selectExpr(
        "domain", "page_id * 3 + k AS pos",
        "concat(CASE WHEN (page_id + k) % 3 = 0 THEN 'Disallow: ' ELSE 'Allow: ' END, left(path, greatest(1, length(path) - k))) AS line",
    )
    lines = rules.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rules"))
    return lines.selectExpr(
        "domain", "200 AS http_status", "concat_ws('\n', 'User-agent: *', transform(rules, r -> r.line)) AS body",
        f"TIMESTAMP_NTZ'{AS_OF}' AS fetched_at",
    )


def stored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from pressgauge.operators.content import content_store

    return {
        "sources": sources(spark, sf_dir),
        "articles": articles(spark, sf_dir),
        "article_contents": content_store(texts(spark, sf_dir)),
        "crawl_jobs": crawl_jobs(spark, sf_dir),
        "sentiment_analyses": analyses(spark, sf_dir),
        "bookmarks": bookmarks(spark, sf_dir),
    }
