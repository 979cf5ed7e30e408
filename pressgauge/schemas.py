"""Column layouts. Instants are TIMESTAMP_NTZ holding UTC wall-clock time."""

from pyspark.sql import types as T

STR, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DBL, BOOL, TS = T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# One item of a feed response; publishers leave any field out.
FEED_ITEM = _struct(
    ("title", STR), ("description", STR), ("url", STR), ("image", STR), ("image_url", STR),
    ("published_at", STR), ("source", STR), ("language", STR), ("country", STR), ("category", STR),
)
FEED_RESPONSE = _struct(("data", T.ArrayType(FEED_ITEM)))
RAW_FEED = T.StructType(
    [T.StructField("ingest_seq", LONG, False), T.StructField("source_name", STR, False), *FEED_ITEM.fields]
)

SOURCES = _struct(("id", LONG, False), ("name", STR, False), ("created_at", TS, False), ("updated_at", TS, False))

ARTICLES = _struct(
    ("id", LONG, False), ("source_id", LONG, False), ("title", STR, False), ("description", STR),
    ("url", STR, False), ("image_url", STR), ("published_at", TS, False), ("language", STR),
    ("country", STR), ("category", STR), ("sentiment_label", STR), ("sentiment_score", DBL),
)

CRAWL_STATUSES = ["PENDING", "IN_PROGRESS", "SUCCESS", "FAILED", "FORBIDDEN_BY_ROBOTS", "RATE_LIMITED"]

CRAWL_JOBS = _struct(
    ("id", LONG, False), ("article_id", LONG, False), ("status", STR, False), ("robots_allowed", BOOL),
    ("http_status", INT), ("fetched_at", TS), ("bytes_downloaded", LONG), ("error_code", STR),
    ("error_message", STR), ("created_at", TS, False), ("updated_at", TS, False),
)

ARTICLE_CONTENTS = _struct(
    ("id", LONG, False), ("article_id", LONG, False), ("content_text", STR, False), ("content_hash", STR, False),
    ("content_length", INT, False), ("extracted_at", TS, False), ("expires_at", TS, False),
)

SENTIMENT_ANALYSES = _struct(
    ("id", LONG, False), ("article_id", LONG, False), ("provider", STR, False), ("model_name", STR),
    ("score", DBL, False), ("magnitude", DBL), ("label", STR, False), ("language", STR), ("analyzed_at", TS, False),
)

USERS = _struct(("id", LONG, False), ("email", STR, False))
BOOKMARKS = _struct(("id", LONG, False), ("user_id", LONG, False), ("article_id", LONG, False))

SENTIMENT_EVENTS = _struct(
    ("event_id", STR, False), ("article_id", LONG, False), ("article_url", STR, False), ("article_title", STR),
    ("source_name", STR), ("published_at", TS, False), ("ingested_at", TS, False),
    ("sentiment_provider", STR, False), ("sentiment_model", STR), ("sentiment_score", DBL, False),
    ("sentiment_magnitude", DBL), ("sentiment_label", STR, False), ("confidence", DBL), ("language", STR),
    ("country", STR), ("category", STR), ("content_length", LONG), ("processing_time_ms", LONG),
    ("extraction_method", STR),
)

PAGES = _struct(("page_id", LONG), ("url", STR), ("html", STR))
ROBOTS_SNAPSHOTS = _struct(("domain", STR, False), ("http_status", INT), ("body", STR), ("fetched_at", TS, False))
LEXICON = _struct(("word", STR, False), ("valence", DBL, False))
