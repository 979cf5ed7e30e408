"""DuckDB SQL giving the result of each registered query."""

from __future__ import annotations

from pressgauge import settings
from pressgauge.plans import sql as Q, views as V
from pressgauge.plans.sql import AS_OF, query

EVENTS = (
    "event_id, article_id, article_url, article_title, source_name, published_at, ingested_at, sentiment_provider, "
    "sentiment_model, sentiment_score, sentiment_magnitude, sentiment_label, CAST(NULL AS DOUBLE) AS confidence, language, "
    "CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS category, content_length, CAST(NULL AS BIGINT) AS processing_time_ms, "
    "extraction_method"
)


def number(text: str) -> str:
    """A 60-bit number from a digest."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


CLEAN = "ingest_seq, source_name, title, description, url, image_url, published_at, language, country, category"
FEED = "title, description, url, image, image_url, published_at, source, language, country, category"
OLD = f"status IN ({Q.words(settings.TERMINAL_STATUSES)}) AND created_at < {AS_OF} - INTERVAL 7 DAYS"
UA = settings.USER_AGENT

TREND = """
    SELECT strftime(ingested_at, '%Y-%m-%d') AS date, sentiment_label, count(*) AS article_count,
        round(avg(sentiment_score), 6) AS avg_sentiment_score, round(avg(sentiment_magnitude), 6) AS avg_magnitude
    FROM sentiment_events WHERE {where} GROUP BY 1, 2 ORDER BY 1 DESC, 2"""

# The fetch chain of each domain, one link per round.
CHAIN = """
    SELECT domain, d, min(t) AS t FROM requests WHERE moves GROUP BY domain, d
    UNION ALL
    SELECT c.domain, c.d, min(r.t) FROM chain c JOIN requests r ON r.domain = c.domain AND r.moves AND r.t >= c.t + c.d
    GROUP BY c.domain, c.d"""
POLITE = """
    SELECT r.*, coalesce(r.t >= (SELECT max(c.t) FROM chain c WHERE c.domain = r.domain AND (c.t < r.t)) + r.d, true)
        AND (NOT EXISTS (SELECT 1 FROM firsts f WHERE f.domain = r.domain AND f.t = r.t AND f.id < r.id)) AS polite
    FROM requests r"""
# Of several fetching requests at one instant the lowest id is the one that fetches.
FIRSTS = """
    SELECT c.domain, c.t, min(r.id) AS id FROM chain c JOIN requests r ON r.domain = c.domain AND r.t = c.t AND r.moves
    GROUP BY c.domain, c.t"""

JOB_ID = number("{} || '|" + V.AS_OF + "'")
CRAWL = {
    "jobs": f"""
        SELECT id, article_id FROM crawl_jobs WHERE status = 'PENDING'
        UNION ALL SELECT {JOB_ID.format('page_id')}, page_id FROM pages WHERE page_id NOT IN (SELECT article_id FROM crawl_jobs)""",
    "tries": "SELECT jobs.id, v.* FROM jobs JOIN verdicts v ON v.page_id = jobs.article_id",
    "requests": """
        SELECT id, domain, t, CAST(coalesce(crawl_delay, 1.0) * 1000000 AS BIGINT) AS d,
            response_status IS NOT NULL AS moves FROM tries WHERE allowed""",
    "chain": CHAIN, "firsts": FIRSTS, "gate": POLITE,
}

ORACLES = {
    "raw_feed_scan": query(f"SELECT ingest_seq, source_name, {FEED} FROM raw", "raw"),
    "multi_source_union": query("""
        SELECT ingest_seq, source_name, title, description, url, CASE WHEN language <> 'de' THEN image END AS image,
            CASE WHEN language <> 'fr' THEN image_url END AS image_url, published_at, source, language, country,
            CASE WHEN language <> 'fr' THEN category END AS category FROM raw""", "raw"),
    "feed_selection": query("""
        SELECT ingest_seq, source_name, category, language, instant AS published,
            CAST(row_number() OVER (PARTITION BY source_name ORDER BY instant DESC, ingest_seq) AS INT) AS rank
        FROM raw WHERE language = 'en' AND category IN ('general', 'business', 'health', 'science', 'technology')
            AND CAST(instant AS DATE) = DATE '2024-01-05' QUALIFY rank <= 25""", "raw"),
    "source_dim": query(
        "SELECT position, name, count(id) AS n_articles FROM (VALUES "
        + ", ".join(f"({i}, {Q.text(n)})" for i, n in enumerate(settings.FEED_SOURCES))
        + ") s(position, name) LEFT JOIN articles ON source_id = position GROUP BY position, name", "articles"),
    "list_sources": query("SELECT id, name FROM sources", "sources"),
    "page_scan": query(f"""
        SELECT p.page_id, p.url, p.html, f.bytes AS bytes_downloaded, f.response_status,
            {AS_OF} + to_microseconds(f.t) AS fetched_at FROM pages p LEFT JOIN fetches f USING (page_id)""", "fetches"),
    "sentiment_events_build": query("""
        SELECT a.article_id || '_' || provider || '_' || CAST(epoch(analyzed_at) AS BIGINT) AS event_id, article_id, url AS article_url,
            title AS article_title, source_name, published_at, analyzed_at AS ingested_at, provider AS sentiment_provider,
            model_name AS sentiment_model, score AS sentiment_score, magnitude AS sentiment_magnitude, label AS sentiment_label,
            r.language, 'web_crawl' AS extraction_method, country, category, CAST(NULL AS DOUBLE) AS confidence,
            CAST(NULL AS BIGINT) AS content_length, CAST(NULL AS BIGINT) AS processing_time_ms
        FROM analyses a JOIN articles r ON r.id = a.article_id""", "analyses", "articles"),
    "sentiment_events_sink": query(f"SELECT {EVENTS}, strftime(ingested_at, '%Y-%m-%d') AS ingested_date FROM sentiment_events", "sentiment_events"),
    "source_catalog": query("""
        SELECT language || '-' || source_name AS "Code", 'Agency ' || source_name || ', "' || language || '"' AS "Name",
            category AS "Category", country AS "Country", language AS "Language", 'https://' || source_name || '.example.org/' || doc_id AS "URL"
        FROM (SELECT *, lang AS language FROM feed) QUALIFY row_number() OVER (PARTITION BY language, source_name ORDER BY doc_id) = 1""", "feed"),
    "normalize_required_fields": query("SELECT ingest_seq, title, description, url FROM clean", "clean"),
    "canonical_url": r"SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS url FROM pages",
    "parse_published_at": query("SELECT ingest_seq, published_at, instant FROM raw", "raw"),
    "dedup_feed": query(f"SELECT {CLEAN} FROM per_source", "per_source"),
    "normalize_articles": query(
        f"SELECT {CLEAN}, s.label AS sentiment_label, s.score AS sentiment_score FROM per_source JOIN scores s ON s.key = ingest_seq",
        "per_source", "lexicon", **Q.scores("SELECT ingest_seq AS key, title || ' ' || description AS text FROM clean")),
    "ingest_new_articles": query(
        f"SELECT {CLEAN.replace('ingest_seq', number('url') + ' AS id', 1)}, s.label AS sentiment_label, s.score AS sentiment_score FROM fresh JOIN scores s ON s.key = ingest_seq",
        "fresh", "lexicon", **Q.scores("SELECT ingest_seq AS key, title || ' ' || description AS text FROM clean")),
    "quarantined_dates": query("SELECT ingest_seq, source_name, url FROM per_source WHERE published_at IS NULL", "per_source"),
    "upsert_sources": query("""
        SELECT name, 'stored' AS outcome FROM sources
        UNION ALL SELECT DISTINCT source_name, 'stored' FROM requested WHERE source_name NOT IN (SELECT name FROM sources)
        UNION ALL SELECT source_name, 'rejected' FROM requested WHERE source_name IN (SELECT name FROM sources)""", "sources", "requested"),
    "validate_articles": query(f"""
        SELECT id, concat_ws(',', CASE WHEN {Q.stripped('title')} = '' THEN 'title_blank' END,
            CASE WHEN length(title) > 255 THEN 'title_too_long' END,
            CASE WHEN length(description) > 1000 THEN 'description_too_long' END) AS violations FROM articles""", "articles"),
    "validate_sources": query("""
        SELECT source_name AS name, lower(source_name) AS normalized,
            CASE WHEN contains(source_name, ' ') THEN 'name_has_space' ELSE '' END AS violations FROM requested""", "requested"),
    "article_by_id": query("SELECT id, title, url, published_at, sentiment_label FROM articles WHERE id = 42", "articles"),
    "article_read": query("""
        SELECT id, title, description, url, image_url, published_at, language, country, category, sentiment_label, sentiment_score,
            source_id, source_name FROM articles""", "articles"),
    "latest_articles": query("SELECT id, title, url, published_at, source_name FROM articles ORDER BY published_at DESC, id LIMIT 20", "articles"),
    "latest_with_analyses": query("""
        SELECT t.id, t.title, t.published_at, t.source_name, a.id AS analysis_id, a.provider, a.score, a.magnitude, a.label
        FROM (SELECT * FROM articles ORDER BY published_at DESC, id LIMIT 40) t LEFT JOIN analyses a ON a.article_id = t.id""", "articles", "analyses"),
    "pending_jobs": query("SELECT id, article_id, status, created_at FROM crawl_jobs WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 10", "crawl_jobs"),
    "user_bookmarks": query("SELECT b.id, user_id, article_id, title, url FROM bookmarks b JOIN articles a ON a.id = b.article_id WHERE user_id = 7", "bookmarks", "articles"),
    "sources_with_articles": query(f"""
        SELECT source_id, name, n_articles, part, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS article_ids
        FROM (SELECT *, {number('CAST(id AS VARCHAR)')} % greatest(CAST(ceil(n_articles / 50.0) AS BIGINT), 1) AS part
            FROM (SELECT source_id, source_name AS name, id, count(*) OVER (PARTITION BY source_id) AS n_articles FROM articles))
        GROUP BY source_id, name, n_articles, part""", "articles"),
    "users_with_bookmarks": query("""
        SELECT u.user_id AS id, 'user' || u.user_id || '@example.org' AS email, count(b.id) AS n_bookmarks, CAST(0 AS BIGINT) AS part,
            coalesce(string_agg(CAST(b.article_id AS VARCHAR), ',' ORDER BY b.article_id), '') AS bookmarks
        FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN bookmarks b USING (user_id) GROUP BY u.user_id""", "bookmarks"),
    "latest_sentiment": query("SELECT article_id, id, label, score, provider, analyzed_at FROM latest", "latest"),
    "article_sentiment_update": query("""
        SELECT a.id, a.url, coalesce(l.label, a.sentiment_label) AS sentiment_label, coalesce(l.score, a.sentiment_score) AS sentiment_score
        FROM articles a LEFT JOIN latest l ON l.article_id = a.id""", "articles", "latest"),
    "content_store": query("SELECT article_id AS id, * FROM article_contents", "article_contents"),
    "content_upsert": query("""
        SELECT article_id, CASE WHEN l.doc_id IS NULL THEN content_hash ELSE sha256(text || ' [updated]') END AS content_hash,
            CASE WHEN l.doc_id IS NULL THEN content_length ELSE CAST(length(text) + 10 AS INT) END AS content_length,
            CASE WHEN l.doc_id IS NULL THEN c.extracted_at ELSE c.extracted_at + INTERVAL 24 HOURS END AS extracted_at,
            CASE WHEN l.doc_id IS NULL THEN expires_at ELSE expires_at + INTERVAL 24 HOURS END AS expires_at
        FROM article_contents c JOIN texts USING (article_id) LEFT JOIN labels l ON l.doc_id = article_id""", "article_contents"),
    "ttl_split": query(f"SELECT article_id, expires_at, expires_at <= {AS_OF} AS expired FROM article_contents", "article_contents"),
    "ttl_cleanup": query(f"SELECT article_id, content_hash, expires_at FROM article_contents WHERE expires_at > {AS_OF}", "article_contents"),
    "content_statistics": query(f"""
        SELECT count(*) AS total_records, count(*) FILTER (expires_at > {AS_OF}) AS active_records,
            count(*) FILTER (expires_at <= {AS_OF}) AS expired_records, coalesce(round(avg(content_length), 2), 0) AS average_content_length
        FROM article_contents""", "article_contents"),
    "content_cleanup_report": query(f"""
        SELECT count(*) FILTER (expires_at <= {AS_OF}) AS expired_content_deleted, count(*) FILTER (expires_at <= {AS_OF}) AS expired_content_found,
            count(*) FILTER (expires_at > {AS_OF}) AS total_content_remaining, min(extracted_at) FILTER (expires_at > {AS_OF}) AS oldest_content_date,
            max(extracted_at) FILTER (expires_at > {AS_OF}) AS newest_content_date, {AS_OF} AS cleanup_timestamp FROM article_contents""", "article_contents"),
    "old_crawl_jobs": query(f"SELECT id, status, created_at FROM crawl_jobs WHERE {OLD}", "crawl_jobs"),
    "crawl_job_retention": query(f"SELECT id, status, created_at FROM crawl_jobs WHERE NOT ({OLD})", "crawl_jobs"),
    "cascade_delete": query("""
        SELECT 'sources' AS table_name, id FROM sources WHERE name >= 'src12'
        UNION ALL SELECT 'articles', id FROM kept
        UNION ALL SELECT 'article_contents', article_id FROM article_contents WHERE article_id NOT IN (SELECT id FROM doomed)
        UNION ALL SELECT 'crawl_jobs', id FROM crawl_jobs WHERE article_id NOT IN (SELECT id FROM doomed)
        UNION ALL SELECT 'sentiment_analyses', id FROM analyses WHERE article_id NOT IN (SELECT id FROM doomed)
        UNION ALL SELECT 'bookmarks', id FROM bookmarks WHERE article_id NOT IN (SELECT id FROM doomed)""",
        "sources", "articles", "article_contents", "crawl_jobs", "analyses", "bookmarks",
        doomed="SELECT id FROM articles WHERE source_name < 'src12' UNION SELECT doc_id FROM labels WHERE toxic = 1",
        kept="SELECT id FROM articles WHERE id NOT IN (SELECT id FROM doomed)"),
    "bookmark_deletes": query("""
        SELECT id, user_id, article_id FROM bookmarks b WHERE NOT EXISTS (
            SELECT 1 FROM events e WHERE e.value > 20 AND e.event_id = b.id AND CASE WHEN e.value > 60 THEN 0 ELSE e.user_id END = b.user_id)""", "bookmarks"),
    "sentiment_trends": query(TREND.format(where=f"ingested_at >= {AS_OF} - INTERVAL 30 DAYS"), "sentiment_events"),
    "sentiment_trends_by_source": query(
        TREND.format(where=f"ingested_at >= {AS_OF} - INTERVAL 14 DAYS AND source_name = 'src7'"), "sentiment_events"),
    "source_sentiment_comparison": query(f"""
        SELECT source_name, sentiment_label, count(*) AS article_count, round(avg(sentiment_score), 6) AS avg_sentiment_score,
            round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (PARTITION BY source_name), 2) AS percentage
        FROM sentiment_events WHERE ingested_at >= {AS_OF} - INTERVAL 30 DAYS AND source_name IS NOT NULL
        GROUP BY source_name, sentiment_label ORDER BY 1, 2""", "sentiment_events"),
    "database_stats": query("""
        SELECT 'sources_count' AS statistic, count(*) AS value FROM sources UNION ALL SELECT 'articles_count', count(*) FROM articles
        UNION ALL SELECT 'article_contents_count', count(*) FROM article_contents UNION ALL SELECT 'crawl_jobs_count', count(*) FROM crawl_jobs
        UNION ALL SELECT 'sentiment_analyses_count', count(*) FROM analyses""", "sources", "articles", "article_contents", "crawl_jobs", "analyses"),
    "crawl_status_breakdown": query("SELECT status, count(*) AS jobs FROM crawl_jobs GROUP BY status", "crawl_jobs"),
    "articles_last_24h": query(f"SELECT count(*) AS articles_last_24h FROM articles WHERE published_at >= {AS_OF} - INTERVAL 24 HOURS", "articles"),
    "cleanup_report": query(f"""
        SELECT section, statistic, CAST(value AS VARCHAR) AS value FROM (
            SELECT 'content_cleanup' AS section, 'expired_content_deleted' AS statistic, count(*) AS value FROM article_contents WHERE expires_at <= {AS_OF}
            UNION ALL SELECT 'content_cleanup', 'expired_content_found', count(*) FROM article_contents WHERE expires_at <= {AS_OF}
            UNION ALL SELECT 'content_cleanup', 'total_content_remaining', count(*) FROM article_contents WHERE expires_at > {AS_OF}
            UNION ALL SELECT 'crawl_job_cleanup', 'old_crawl_jobs_deleted', count(*) FROM crawl_jobs WHERE {OLD}
            UNION ALL SELECT 'crawl_job_cleanup', 'old_crawl_jobs_found', count(*) FROM crawl_jobs WHERE {OLD}
            UNION ALL SELECT 'database_stats', 'sources_count', count(*) FROM sources
            UNION ALL SELECT 'database_stats', 'articles_count', count(*) FROM articles
            UNION ALL SELECT 'database_stats', 'article_contents_count', count(*) FROM article_contents WHERE expires_at > {AS_OF}
            UNION ALL SELECT 'database_stats', 'crawl_jobs_count', count(*) FROM crawl_jobs WHERE NOT ({OLD})
            UNION ALL SELECT 'database_stats', 'sentiment_analyses_count', count(*) FROM analyses
            UNION ALL SELECT 'crawl_job_status', status, count(*) FROM crawl_jobs WHERE NOT ({OLD}) GROUP BY status
            UNION ALL SELECT 'database_stats', 'articles_last_24h', count(*) FROM articles WHERE published_at >= {AS_OF} - INTERVAL 24 HOURS
        )""", "sources", "articles", "article_contents", "crawl_jobs", "analyses"),
    "lexicon_sentiment": query(
        "SELECT key AS doc_id, hits, score, label FROM scores", "lexicon", **Q.scores("SELECT doc_id AS key, text FROM documents")),
    "lexicon_sentiment_plain": query(f"""
        SELECT doc_id, hits, score, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS label
        FROM (SELECT doc_id, coalesce(hits, 0) AS hits, coalesce(round(total / sqrt(total * total + 15), 4), 0.0) AS score
            FROM documents LEFT JOIN (SELECT key, sum(valence) AS total, count(*) AS hits FROM tokens JOIN lexicon ON word = lower(tok) GROUP BY key) ON key = doc_id)""",
        "lexicon", **{k: v for k, v in Q.scores("SELECT doc_id AS key, text FROM documents").items() if k in ("raw_tokens", "tokens")}),
    "label_by_provider": query("""
        SELECT id, lower(provider) AS provider, score, label, bound AS positive_threshold, -bound AS negative_threshold FROM analyses""", "analyses"),
    "sentiment_with_fallback": query(f"""
        SELECT doc_id, CASE WHEN blank THEN 0.0 WHEN answered THEN model ELSE s.score END AS score,
            CASE WHEN answered AND NOT blank THEN CAST(quality + toxic AS DOUBLE) END AS magnitude,
            CASE WHEN blank THEN 'neutral' WHEN answered THEN CASE WHEN model >= 0.25 THEN 'positive' WHEN model <= -0.25 THEN 'negative' ELSE 'neutral' END
                ELSE s.label END AS label,
            CASE WHEN blank OR answered THEN 'GCP_NL' ELSE 'VADER' END AS provider_used
        FROM (SELECT doc_id, {Q.stripped('text')} = '' AS blank, quality IS NOT NULL AS answered, CAST(quality - toxic AS DOUBLE) / 2 AS model, quality, toxic
            FROM documents LEFT JOIN labels USING (doc_id)) JOIN scores s ON s.key = doc_id""",
        "lexicon", **Q.scores("SELECT doc_id AS key, text FROM documents")),
    "url_domain": """
        SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS domain,
            'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || '/robots.txt' AS robots_url FROM pages""",
    "articles_without_jobs": query("SELECT id, url FROM articles WHERE id NOT IN (SELECT article_id FROM crawl_jobs) ORDER BY id LIMIT 20", "articles", "crawl_jobs"),
    "create_crawl_jobs": query(f"""
        SELECT {JOB_ID.format('id')} AS id, id AS article_id, 'PENDING' AS status, {AS_OF} AS created_at, {AS_OF} AS updated_at
        FROM articles WHERE id NOT IN (SELECT article_id FROM crawl_jobs)""", "articles", "crawl_jobs"),
    "robots_snapshot": query(f"""
        SELECT domain, CASE n % 4 WHEN 0 THEN 404 ELSE 200 END AS http_status,
            {AS_OF} - to_hours(CAST(CASE n % 4 WHEN 1 THEN 30 ELSE n % 4 END AS INT)) AS fetched_at, n % 4 <> 1 AS fresh FROM hosts""", "hosts"),
    "robots_refetch": query("SELECT domain FROM hosts WHERE n % 4 = 1", "hosts"),
    "robots_rules": query("""
        SELECT domain, 1 AS group_no, true AS is_default, false AS applies, CAST(n % 4 AS DOUBLE) AS crawl_delay, r AS rule_no, r = 1 AS allow,
            CASE r WHEN 0 THEN '/' || hi || '/1' ELSE '/' END AS path FROM hosts, (VALUES (0), (1)) v(r) WHERE n % 4 >= 2
        UNION ALL
        SELECT domain, 2, false, true, 2.0, r, r = 0, CASE r WHEN 0 THEN '/' || lo || '/1' ELSE '/' || lo || '/' END
        FROM hosts, (VALUES (0), (1)) v(r) WHERE n % 4 >= 2 AND domain LIKE '%.org'""", "hosts"),
    "robots_check_long": query(f"""
        SELECT page_id, domain, coalesce(first, true) AS allowed, CASE WHEN coalesce(first, true) THEN 'Allowed by robots.txt'
            ELSE 'Disallowed by robots.txt for user-agent ''{UA}''' END AS reason FROM (
            SELECT f.page_id, any_value(f.domain) AS domain, arg_min((r.page_id + k) % 3 <> 0, r.page_id * 3 + k) AS first
            FROM fetches f JOIN (SELECT *, left(path, greatest(1, length(path) - k)) AS rule FROM fetches, range(3) t(k)) r
                ON f.domain = r.domain AND starts_with(f.path, r.rule) GROUP BY f.page_id)""", "fetches"),
    "robots_check": query(f"""
        SELECT page_id, domain, allowed, crawl_delay, CASE WHEN file_status IS NULL THEN 'No robots.txt or fetch failed (permissive default)'
            WHEN allowed THEN 'Allowed by robots.txt' ELSE 'Disallowed by robots.txt for user-agent ''{UA}''' END AS reason FROM verdicts""", "verdicts"),
    "politeness_gate": query(
        "SELECT id AS job_id, polite FROM gate", recursive=True,
        requests="""SELECT event_id AS id, 'host' || user_id AS domain, epoch_us(ts) AS t, 3600000000 * (1 + user_id % 5) AS d,
            event_type <> 'error' AS moves FROM events""",
        chain=CHAIN, firsts=FIRSTS, gate=POLITE),
    "crawl_outcomes": query(f"""
        SELECT v.id, v.page_id AS article_id,
            CASE WHEN NOT allowed THEN 'FORBIDDEN_BY_ROBOTS' WHEN NOT polite THEN 'RATE_LIMITED' WHEN response_status = 200 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
            allowed AS robots_allowed,
            CASE WHEN allowed AND polite AND response_status = 200 THEN 200 END AS http_status,
            CASE WHEN allowed AND polite AND response_status = 200 THEN {AS_OF} + to_microseconds(v.t) END AS fetched_at,
            CASE WHEN allowed AND polite AND response_status = 200 THEN bytes END AS bytes_downloaded,
            CASE WHEN allowed AND polite AND response_status IS DISTINCT FROM 200 THEN 'NETWORK_ERROR' END AS error_code,
            CASE WHEN NOT allowed THEN 'Disallowed by robots.txt for user-agent ''{UA}''' WHEN NOT polite THEN 'Rate limited - respecting crawl delay'
                WHEN response_status IS NULL THEN 'Network error: connection reset' WHEN response_status <> 200 THEN 'Network error: HTTP status ' || response_status END AS error_message
        FROM tries v LEFT JOIN gate g ON g.id = v.id""", "verdicts", "crawl_jobs", recursive=True, **CRAWL),
    "crawl_run_summary": query("""
        SELECT count(*) AS processed, count(*) FILTER (allowed AND polite AND response_status = 200) AS successful,
            count(*) - count(*) FILTER (allowed AND polite AND response_status = 200) AS failed,
            (SELECT count(*) FROM pages WHERE page_id NOT IN (SELECT article_id FROM crawl_jobs)) AS new_jobs_created
        FROM tries v LEFT JOIN gate g ON g.id = v.id""", "verdicts", "crawl_jobs", recursive=True, **CRAWL),
}

# The outcome of each try, then the stored jobs that were not tried.
OUTCOME = ORACLES["crawl_outcomes"]
ORACLES["crawl_jobs_stored"] = f"""
    SELECT * FROM ({OUTCOME})
    UNION ALL SELECT event_id, user_id, {V.JOB_STATUS}, event_type <> 'purchase', CASE WHEN event_type = 'click' THEN 200 END,
        CASE WHEN event_type = 'click' THEN ts END, CAST(length(props) AS BIGINT), CASE WHEN event_type = 'error' THEN 'NETWORK_ERROR' END, NULL
    FROM events WHERE {V.JOB_STATUS} <> 'PENDING' OR user_id NOT IN (SELECT page_id FROM pages)"""

ORACLES["stream_ingest_articles"] = query(
    f"SELECT {CLEAN.replace('ingest_seq, ', '', 1)}, s.label AS sentiment_label, s.score AS sentiment_score FROM fresh JOIN scores s ON s.key = ingest_seq",
    "fresh", "lexicon", **Q.scores("SELECT ingest_seq AS key, title || ' ' || description AS text FROM clean"))
ORACLES["ingest_articles"] = query(
    f"""SELECT {number('url')} AS id, coalesce(o.id, {number('source_name')}) AS source_id, title, description, url, image_url, published_at,
        language, country, category, s.label AS sentiment_label, s.score AS sentiment_score
    FROM fresh JOIN scores s ON s.key = ingest_seq LEFT JOIN sources o ON o.name = source_name""",
    "fresh", "lexicon", "sources", **Q.scores("SELECT ingest_seq AS key, title || ' ' || description AS text FROM clean"))
ORACLES["ingest_run_stored"] = ORACLES["ingest_articles"]
ORACLES["ingest_run_counts"] = query("""
    SELECT (SELECT count(DISTINCT url) FROM stored_urls) + (SELECT count(*) FROM fresh) AS stored_articles,
        (SELECT count(DISTINCT (doc_id // 500, source)) FROM documents) AS responses, CAST(0 AS BIGINT) AS failed_responses,
        (SELECT count(*) FROM raw) AS items, (SELECT count(*) FROM per_source WHERE published_at IS NULL) AS undated_items,
        (SELECT count(DISTINCT source_name) FROM fresh WHERE source_name NOT IN (SELECT name FROM sources)) AS new_sources,
        (SELECT count(*) FROM fresh) AS new_articles""", "fresh", "sources")
ORACLES["provider_info"] = query("""
    SELECT p.*, count(a.id) AS n_analyses FROM (VALUES """ + ", ".join(
    f"({Q.text(n)}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {Q.text(m)}, {str(settings.FALLBACK_ENABLED).lower()}, {Q.text(','.join(settings.SUPPORTED_LANGUAGES))})"
    for n, a, b, m in settings.PROVIDERS
) + """) p(provider, positive_threshold, negative_threshold, model_name, fallback_enabled, supported_languages)
    LEFT JOIN analyses a ON a.provider = p.provider GROUP BY ALL""", "analyses")
ORACLES["retention_write_back"] = query(f"""
    SELECT 'article_contents' AS table_name, article_id AS id FROM article_contents WHERE expires_at > {AS_OF}
    UNION ALL SELECT 'crawl_jobs', id FROM crawl_jobs WHERE NOT ({OLD})""", "article_contents", "crawl_jobs")
ORACLES["politeness_gate_short"] = ORACLES["politeness_gate"].replace("3600000000 *", "1000000 *")
ORACLES["stream_url_dedup"] = ORACLES["dedup_feed"]
ORACLES["stream_sentiment_trends"] = query(TREND.format(where="true"), "sentiment_events")
ORACLES["stream_events_sink"] = ORACLES["sentiment_events_sink"]
ORACLES["stream_politeness_gate"] = ORACLES["politeness_gate"]
ORACLES["content_merge"] = query("""
    SELECT article_id AS id, article_id, CASE WHEN l.doc_id IS NULL THEN content_text ELSE substr(text || ' [updated]', 1, 1024) END AS content_text,
        CASE WHEN l.doc_id IS NULL THEN content_hash ELSE sha256(text || ' [updated]') END AS content_hash,
        CASE WHEN l.doc_id IS NULL THEN content_length ELSE CAST(length(text) + 10 AS INT) END AS content_length,
        CASE WHEN l.doc_id IS NULL THEN c.extracted_at ELSE c.extracted_at + INTERVAL 24 HOURS END AS extracted_at,
        CASE WHEN l.doc_id IS NULL THEN expires_at ELSE expires_at + INTERVAL 24 HOURS END AS expires_at
    FROM article_contents c JOIN texts USING (article_id) LEFT JOIN labels l ON l.doc_id = article_id""", "article_contents")
ORACLES["bookmark_deletes_stored"] = ORACLES["bookmark_deletes"]
ORACLES["article_sentiment_merge"] = ORACLES["article_sentiment_update"]
ORACLES["stream_content_expiry"] = query("""
    SELECT article_id, content_hash, expires_at FROM article_contents
    WHERE expires_at > (SELECT max(extracted_at) FROM article_contents)""", "article_contents")
ORACLES["unreadable_responses"] = """
    SELECT DISTINCT doc_id // 500 * 1000 + CAST(substr(source, 4) AS BIGINT) AS payload_seq, source AS source_name
    FROM documents WHERE doc_id // 500 % 5 < 3"""
