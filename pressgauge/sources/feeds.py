"""Feed responses, feed selection and the source catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pressgauge import settings
from pressgauge.functions.text import parse_iso
from pressgauge.schemas import FEED_ITEM, FEED_RESPONSE, RAW_FEED, T

# One line per response: which source was asked, in which order, and the body it returned.
RESPONSES = T.StructType([
    T.StructField("payload_seq", T.LongType(), False),
    T.StructField("source_name", T.StringType(), False),
    T.StructField("payload", T.StringType()),
])


def read_responses(spark: SparkSession, *paths: str) -> DataFrame:
    """Batch scan of response log files (JSON lines). A broken line does not stop the rest."""
    return spark.read.schema(RESPONSES).option("mode", "PERMISSIVE").json(list(paths)).filter("source_name IS NOT NULL")


def stream_responses(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", max_files).json(path)
        .filter("source_name IS NOT NULL")
    )


def raw_feed(responses: DataFrame) -> DataFrame:
    """Responses to feed items, tagged with source and arrival order.

    ``ingest_seq`` packs (response number, position in the response): it is the
    only order there is, and every first-wins rule downstream uses it.
    """
    body = F.from_json("payload", FEED_RESPONSE, {"mode": "PERMISSIVE"})
    number = F.when(F.col("payload_seq").between(0, (1 << 31) - 1), F.col("payload_seq")).otherwise(
        F.raise_error("response numbers must fit 31 bits")
    )
    # The outer form spares the size filter Spark would add, which parses every body a second time.
    items = responses.select("payload_seq", "source_name", F.posexplode_outer(body["data"]).alias("pos", "item"))
    return items.filter("item IS NOT NULL").select(
        F.shiftleft(number, 32).bitwiseOR(F.col("pos").cast("long")).alias("ingest_seq"),
        "source_name",
        *[F.col("item")[f.name].alias(f.name) for f in FEED_ITEM.fields],
    )


def unreadable_responses(responses: DataFrame) -> DataFrame:
    """Responses without a ``data`` list: the failed sources of a run."""
    body = F.from_json("payload", FEED_RESPONSE, {"mode": "PERMISSIVE"})
    return responses.filter(F.col("payload").isNull() | body["data"].isNull())


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Bag union of per-source batches; a column one batch lacks becomes NULL."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    return merged.select(*[f.name for f in RAW_FEED.fields])


def select_feed(
    raw: DataFrame,
    day: str,
    languages: list[str] = settings.FEED_LANGUAGES,
    categories: str = settings.FEED_CATEGORIES,
    limit: int = settings.FEED_LIMIT,
) -> DataFrame:
    """The request parameters as a query: language, +/- categories, one day, newest n per source.

    The rank filter lets Spark keep n rows per source in each task before the
    exchange, so a source holding most of the feed costs n rows per task.
    """
    names = [c.strip() for c in categories.split(",") if c.strip()]
    wanted = [c for c in names if not c.startswith("-")]
    unwanted = [c[1:] for c in names if c.startswith("-")]
    published = parse_iso(F.col("published_at"))
    rows = raw.withColumn("published", published).filter(
        F.col("language").isin(languages) & (F.to_date("published") == F.lit(day).cast("date"))
    )
    # An item without a category is in no wanted one, and in no unwanted one either.
    if wanted:
        rows = rows.filter(F.col("category").isin(wanted))
    if unwanted:
        rows = rows.filter(F.coalesce(~F.col("category").isin(unwanted), F.lit(True)))
    newest = Window.partitionBy("source_name").orderBy(F.desc("published"), "ingest_seq")
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def source_dim(spark: SparkSession, names: list[str] = settings.FEED_SOURCES) -> DataFrame:
    """The configured sources with their fetch position."""
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


def source_catalog(found: DataFrame) -> DataFrame:
    """First row per code wins over all keyword searches. ``found`` has code, ... , seq.

    The winner is picked on (code, seq) alone; the wide rows move once, by seq.
    """
    first = found.groupBy("code").agg(F.min("seq").alias("seq")).select("seq")
    return found.join(first, "seq", "left_semi").select(
        F.col("code").alias("Code"), F.col("name").alias("Name"), F.col("category").alias("Category"),
        F.col("country").alias("Country"), F.col("language").alias("Language"), F.col("url").alias("URL"),
    )


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").option("header", True).csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    schema = "Code string, Name string, Category string, Country string, Language string, URL string"
    return spark.read.schema(schema).option("header", True).csv(path)
