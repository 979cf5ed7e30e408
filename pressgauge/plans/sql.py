"""DuckDB text of the views in ``views.py``, as common table expressions."""

from __future__ import annotations

from pressgauge import settings
from pressgauge.operators import sentiment as S
from pressgauge.plans import views as V

AS_OF = f"TIMESTAMP '{V.AS_OF}'"
START = "TIMESTAMP '2024-01-01 00:00:00'"
SPACES = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return ", ".join(text(v) for v in values)


def stripped(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{SPACES}+', ''), '{SPACES}+$', '')"


FEED_TIME = f"{START} + to_hours(CAST(doc_id % 720 AS INT))"

CTE = {
    "feed": f"""
        SELECT doc_id, source AS source_name, lang, {V.FIRST_LINE} AS first_line, {V.REST} AS rest, {V.STORY} AS story,
            (doc_id // {V.PAGE_SIZE}) * 1000 + CAST(substr(source, 4) AS BIGINT) AS payload_seq,
            row_number() OVER (PARTITION BY source, doc_id // {V.PAGE_SIZE} ORDER BY doc_id) - 1 AS pos,
            {V.COUNTRY} AS country, {V.CATEGORY} AS category
        FROM documents""",
    "raw": f"""
        SELECT payload_seq * 4294967296 + pos AS ingest_seq, source_name, '  ' || first_line || chr(9) AS title, rest AS description,
            'HTTPS://News.example.org/a/' || story || ';v=1?utm=' || doc_id || '#top' AS url,
            CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'https://img.example.org/' || story || '.png' END AS image,
            'https://img.example.org/alt/' || story || '.png' AS image_url,
            CASE WHEN doc_id % 60 = 7 THEN 'soon'
                WHEN doc_id % 4 = 0 THEN strftime({FEED_TIME}, '%Y-%m-%dT%H:%M:%SZ')
                WHEN doc_id % 4 = 1 THEN strftime({FEED_TIME} + INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%S+02:00')
                WHEN doc_id % 4 = 2 THEN strftime({FEED_TIME}, '%Y%m%dT%H%M%SZ')
                ELSE strftime({FEED_TIME}, '%Y-%m-%d') END AS published_at,
            CASE WHEN doc_id % 60 <> 7 THEN CASE WHEN doc_id % 4 = 3 THEN date_trunc('day', {FEED_TIME}) ELSE {FEED_TIME} END END AS instant,
            source_name AS source, lang AS language, country, category, story
        FROM feed""",
    "clean": f"""
        SELECT ingest_seq, source_name, {stripped('title')} AS title, {stripped('description')} AS description,
            'https://News.example.org/a/' || story AS url, coalesce(nullif(image, ''), image_url) AS image_url,
            instant AS published_at, language, country, category
        FROM raw WHERE {stripped('title')} <> '' AND {stripped('description')} <> ''""",
    "per_source": "SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY url, source_name ORDER BY ingest_seq) = 1",
    "stored_urls": f"SELECT DISTINCT 'https://News.example.org/a/' || {V.STORY} AS url FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "new_urls": """
        SELECT * FROM per_source WHERE published_at IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY ingest_seq) = 1""",
    "fresh": "SELECT * FROM new_urls WHERE NOT EXISTS (SELECT 1 FROM stored_urls s WHERE s.url = new_urls.url)",
    "articles": f"""
        SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, {V.FIRST_LINE} AS title, {V.REST} AS description,
            'https://news.example.org/d/' || doc_id AS url, 'https://img.example.org/' || doc_id || '.png' AS image_url,
            {FEED_TIME} AS published_at, lang AS language, {V.COUNTRY} AS country, {V.CATEGORY} AS category,
            CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment_label,
            CAST(quality - toxic AS DOUBLE) / 2 AS sentiment_score, source AS source_name
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "sources": "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name FROM documents",
    "requested": """
        SELECT n_name AS source_name FROM nation UNION ALL SELECT r_name FROM region
        UNION ALL SELECT DISTINCT source FROM documents""",
    "sentiment_events": f"""
        SELECT event_id || '_VADER_' || CAST(floor(epoch(ts)) AS BIGINT) AS event_id, user_id AS article_id,
            'https://news.example.org/d/' || user_id AS article_url, event_type AS article_title,
            CASE WHEN user_id % 20 <> 0 THEN 'src' || (user_id % 20) END AS source_name, ts AS published_at, ts AS ingested_at,
            'VADER' AS sentiment_provider, 'vader_lexicon' AS sentiment_model, {V.SCORE_OF_EVENT} AS sentiment_score,
            CASE WHEN event_type <> 'error' THEN value END AS sentiment_magnitude, {V.LABEL_OF_EVENT} AS sentiment_label,
            'en' AS language, CAST(length(props) AS BIGINT) AS content_length, 'web_crawl' AS extraction_method
        FROM events""",
    "crawl_jobs": f"""
        SELECT event_id AS id, user_id AS article_id, {V.JOB_STATUS} AS status, event_type <> 'purchase' AS robots_allowed,
            ts AS created_at FROM events""",
    "texts": f"SELECT doc_id AS article_id, text, {FEED_TIME} AS extracted_at FROM documents",
    "article_contents": f"""
        SELECT article_id, substr(text, 1, {settings.CONTENT_MAX_CHARS}) AS content_text, sha256(text) AS content_hash,
            CAST(length(text) AS INT) AS content_length, extracted_at, extracted_at + INTERVAL 168 HOURS AS expires_at FROM texts""",
    "bookmarks": """
        SELECT event_id AS id, user_id, CAST(floor(value) AS BIGINT) AS article_id FROM events WHERE event_type = 'purchase'""",
    "analyses": f"""
        SELECT *, CASE WHEN score >= bound THEN 'positive' WHEN score <= -bound THEN 'negative' ELSE 'neutral' END AS label
        FROM (
            SELECT doc_id * 2 AS id, doc_id AS article_id, 'VADER' AS provider, 'vader_lexicon' AS model_name,
                round(CAST(n_chars % 2001 AS DOUBLE) / 1000 - 1, 3) AS score, CAST(NULL AS DOUBLE) AS magnitude,
                {FEED_TIME} AS analyzed_at, CAST(0.05 AS DOUBLE) AS bound FROM documents
            UNION ALL
            SELECT doc_id * 2 + 1, doc_id, 'GCP_NL', 'gcp_nl_v1', CAST(quality - toxic AS DOUBLE) / 2,
                CAST(quality + toxic AS DOUBLE), {FEED_TIME} + INTERVAL 1 HOUR, CAST(0.25 AS DOUBLE) FROM labels
        )""",
    "latest": "SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY analyzed_at DESC, id DESC) = 1",
    "own_words": "SELECT * FROM (VALUES " + ", ".join(f"({text(w)}, CAST({v} AS DOUBLE))" for w, v in S.DEFAULT_WORDS.items()) + ") t(word, valence)",
    "lexicon": """
        SELECT word, valence FROM own_words UNION ALL
        SELECT word, CAST(length(word) * 7 % 9 - 4 AS DOUBLE) * 0.5 FROM (
            SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark
        ) WHERE word <> '' AND word NOT IN (SELECT word FROM own_words)""",
    "hosts": """
        SELECT domain, count(*) AS n, min(section) AS lo, max(section) AS hi FROM (
            SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain,
                regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS section FROM pages
        ) GROUP BY domain""",
    "fetches": f"""
        SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain,
            regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path,
            page_id * 20000 AS t, {V.RESPONSE_STATUS} AS response_status, octet_length(encode(html)) AS bytes
        FROM pages LEFT JOIN events ON event_id = page_id""",
    # The files are written by rule, so the verdict can be told from the same rule without parsing.
    # n % 4 = 1: the newest fetch failed and the older file is stale, which means permissive.
    "verdicts": """
        SELECT f.*, h.n, h.lo, h.hi,
            CASE n % 4 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS file_status,
            CASE WHEN n % 4 < 2 THEN true
                WHEN f.domain LIKE '%.org' THEN starts_with(path, '/' || lo || '/1') OR NOT starts_with(path, '/' || lo || '/')
                ELSE NOT starts_with(path, '/' || hi || '/1') END AS allowed,
            CASE WHEN n % 4 < 2 THEN NULL WHEN f.domain LIKE '%.org' THEN 2.0 ELSE CAST(n % 4 AS DOUBLE) END AS crawl_delay
        FROM fetches f JOIN hosts h USING (domain)""",
}

# What each expression reads.
NEEDS = {
    "raw": ["feed"], "clean": ["raw"], "per_source": ["clean"], "new_urls": ["per_source"], "fresh": ["new_urls", "stored_urls"],
    "article_contents": ["texts"], "latest": ["analyses"], "lexicon": ["own_words"], "verdicts": ["fetches", "hosts"],
}


def _order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(NEEDS.get(name, []), seen)
            seen.append(name)
    return seen


def query(body: str, *needs: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` the named views and the extra ones (in the given order) around ``body``."""
    parts = [f"{name} AS ({CTE[name].strip()})" for name in _order(list(needs), [])]
    parts += [f"{name} AS ({sql.strip()})" for name, sql in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def scores(texts: str, prefix: str = "") -> dict[str, str]:
    """CTEs scoring ``texts(key, text)`` with ``lexicon``; the last one is ``{prefix}scores``.

    Tokens are rows here; neighbours come from window offsets.
    """
    p = prefix
    bare = f"trim(raw, {text('!\"#$%&' + chr(39) + '()*+,-./:;<=>?@[' + chr(92) + ']^_`{|}~')})"
    upper = "(upper({0}) = {0} AND lower({0}) <> {0})"
    near = {"b1": 1, "b2": 2, "b3": 3}
    neg = words(S.NEGATIONS)
    idiom_case = lambda e: "CASE " + e + " " + " ".join(f"WHEN {text(k)} THEN CAST({v} AS DOUBLE)" for k, v in S.IDIOMS.items()) + " END"

    def gram(*names: str) -> str:
        return "concat_ws(' ', " + ", ".join(f"lower(coalesce({n}, ''))" for n in names) + ")"

    def scaled(back: int, v: str) -> str:
        b = f"b{back}"
        size = f"CASE WHEN lower({b}) IN ({words(S.BOOSTERS)}) THEN {S.BOOST} WHEN lower({b}) IN ({words(S.DAMPENERS)}) THEN -{S.BOOST} END"
        loud = f"CASE WHEN {upper.format(b)} AND mixed THEN CASE WHEN {v} > 0 THEN {S.CAPS} ELSE -{S.CAPS} END ELSE 0 END"
        return f"coalesce((CASE WHEN {v} < 0 THEN -({size}) ELSE ({size}) END + {loud}) * {S.DISTANCE_DAMPING[back]}, 0)"

    def negation(back: int) -> str:
        b = f"b{back}"
        plain = f"CASE WHEN lower({b}) IN ({neg}) OR contains(lower({b}), 'n''t') THEN {S.NEGATE} ELSE 1.0 END"
        if back == 1:
            return plain
        if back == 2:
            stressed = "lower(b2) = 'never' AND lower(b1) IN ('so', 'this')"
            sure = "lower(b2) = 'without' AND lower(b1) = 'doubt'"
        else:
            stressed = "(lower(b3) = 'never' AND lower(b2) IN ('so', 'this')) OR lower(b1) IN ('so', 'this')"
            sure = "lower(b3) = 'without' AND (lower(b2) = 'doubt' OR lower(b1) = 'doubt')"
        return f"CASE WHEN {stressed} THEN 1.25 WHEN {sure} THEN 1.0 ELSE {plain} END"

    plain = {back: f"(pos >= {back} AND k{back} IS NULL)" for back in (1, 2, 3)}
    idioms = (
        f"coalesce(CASE WHEN after > 1 THEN {idiom_case(gram('word', 'a1', 'a2'))} END, CASE WHEN after > 0 THEN {idiom_case(gram('word', 'a1'))} END, "
        + ", ".join(idiom_case(gram(*g)) for g in (("b1", "word"), ("b2", "b1", "word"), ("b2", "b1"), ("b3", "b2", "b1"), ("b3", "b2")))
        + ", v32)"
        + "".join(f" - CASE WHEN {gram(*g)} IN ({words(S.DAMPENER_PHRASES)}) THEN {S.BOOST} ELSE 0 END" for g in (("b3", "b2", "b1"), ("b3", "b2"), ("b2", "b1")))
    )
    return {
        f"{p}raw_tokens": f"SELECT key, text, unnest(tokens) AS raw, generate_subscripts(tokens, 1) - 1 AS pos, len(tokens) AS n FROM ("
        f"SELECT key, text, regexp_split_to_array({stripped('text')}, '{SPACES}+') AS tokens FROM ({texts}) WHERE {stripped('text')} <> '')",
        f"{p}tokens": f"SELECT key, pos, n, CASE WHEN length({bare}) <= 2 THEN raw ELSE {bare} END AS tok FROM {p}raw_tokens",
        f"{p}flags": f"SELECT key, bool_or({upper.format('tok')}) AND bool_or(NOT {upper.format('tok')}) AS mixed, min(CASE WHEN lower(tok) = 'but' THEN pos END) AS but FROM {p}tokens GROUP BY key",
        f"{p}placed": "SELECT key, pos, n - 1 - pos AS after, tok, "
        + ", ".join(f"lag(tok, {d}) OVER w AS {b}" for b, d in near.items())
        + f", lead(tok, 1) OVER w AS a1, lead(tok, 2) OVER w AS a2 FROM {p}tokens WINDOW w AS (PARTITION BY key ORDER BY pos)",
        f"{p}hit": f"SELECT t.*, t.tok AS word, l.valence, f.mixed, f.but, l1.word AS k1, l2.word AS k2, l3.word AS k3, la.word AS ka FROM {p}placed t "
        f"JOIN lexicon l ON l.word = lower(t.tok) JOIN {p}flags f USING (key) LEFT JOIN lexicon l1 ON l1.word = lower(b1) "
        "LEFT JOIN lexicon l2 ON l2.word = lower(b2) LEFT JOIN lexicon l3 ON l3.word = lower(b3) LEFT JOIN lexicon la ON la.word = lower(a1)",
        f"{p}v0": "SELECT *, CASE WHEN lower(b1) = 'no' OR lower(b2) = 'no' OR (lower(b3) = 'no' AND lower(b1) IN ('or', 'nor')) "
        f"THEN valence * {S.NEGATE} WHEN lower(word) = 'no' AND ka IS NOT NULL THEN 0.0 ELSE valence END AS s0 FROM {p}hit",
        f"{p}v0c": f"SELECT *, CASE WHEN {upper.format('word')} AND mixed THEN s0 + CASE WHEN s0 > 0 THEN {S.CAPS} ELSE -{S.CAPS} END ELSE s0 END AS c0 FROM {p}v0",
        f"{p}v1a": f"SELECT *, CASE WHEN {plain[1]} THEN c0 + {scaled(1, 'c0')} ELSE c0 END AS v11 FROM {p}v0c",
        f"{p}v1b": f"SELECT *, CASE WHEN {plain[1]} THEN v11 * ({negation(1)}) ELSE v11 END AS v12 FROM {p}v1a",
        f"{p}v2a": f"SELECT *, CASE WHEN {plain[2]} THEN v12 + {scaled(2, 'v12')} ELSE v12 END AS v21 FROM {p}v1b",
        f"{p}v2b": f"SELECT *, CASE WHEN {plain[2]} THEN v21 * ({negation(2)}) ELSE v21 END AS v22 FROM {p}v2a",
        f"{p}v3a": f"SELECT *, CASE WHEN {plain[3]} THEN v22 + {scaled(3, 'v22')} ELSE v22 END AS v31 FROM {p}v2b",
        f"{p}v3b": f"SELECT *, CASE WHEN {plain[3]} THEN v31 * ({negation(3)}) ELSE v31 END AS v32 FROM {p}v3a",
        f"{p}v3c": f"SELECT *, CASE WHEN {plain[3]} THEN {idioms} ELSE v32 END AS v33 FROM {p}v3b",
        f"{p}valued": f"SELECT key, CASE WHEN lower(word) IN ({words(S.BOOSTERS + S.DAMPENERS)}) OR (lower(word) = 'kind' AND lower(a1) = 'of') THEN 0.0 ELSE "
        f"v33 * CASE WHEN lower(b1) = 'least' AND k1 IS NULL AND (pos = 1 OR lower(b2) NOT IN ('at', 'very')) THEN {S.NEGATE} ELSE 1.0 END * "
        "CASE WHEN but IS NULL OR pos = but THEN 1.0 WHEN pos < but THEN 0.5 ELSE 1.5 END END AS val "
        f"FROM {p}v3c",
        f"{p}sums": f"SELECT key, sum(val) AS total, count(*) AS hits FROM {p}valued GROUP BY key",
        f"{p}marks": f"SELECT key, least(length(text) - length(replace(text, '!', '')), 4) * 0.292 + CASE WHEN q > 3 THEN 0.96 WHEN q > 1 THEN q * 0.18 ELSE 0 END AS emphasis "
        f"FROM (SELECT key, text, length(text) - length(replace(text, '?', '')) AS q FROM ({texts}))",
        f"{p}loud": f"SELECT key, coalesce(hits, 0) AS hits, CAST(CASE WHEN total > 0 THEN total + emphasis WHEN total < 0 THEN total - emphasis ELSE 0 END AS DOUBLE) AS x "
        f"FROM {p}marks LEFT JOIN {p}sums USING (key)",
        f"{p}scores": "SELECT key, hits, score, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS label "
        f"FROM (SELECT key, hits, round(x / sqrt(x * x + {S.ALPHA}), 4) AS score FROM {p}loud)",
    }
