"""Stored tables: Parquet folders, laid out for the queries that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgauge.schemas import T
from pressgauge.sources.versions import Versions


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Range-partitioned read of a table that still lives in a relational database."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def page_scan(pages: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Page snapshots standing in for the live GET: url, html, size in bytes."""
    scanned = pages.select(
        "page_id", "url", "html", F.octet_length("html").cast("long").alias("bytes_downloaded")
    )
    return scanned.join(fetches, "page_id", "left") if fetches is not None else scanned


# Which day column splits a table, and what its files are sorted by.
LAYOUT = {
    "articles": ("published_at", ["source_id"]),
    "article_contents": ("expires_at", ["article_id"]),
    "crawl_jobs": ("created_at", ["status"]),
    "sentiment_analyses": ("analyzed_at", ["article_id"]),
    "sentiment_events": ("ingested_at", ["sentiment_label", "source_name"]),
}


def day_column(table: str) -> str:
    return LAYOUT[table][0].removesuffix("_at") + "_date"


def lay_out(rows: DataFrame, table: str) -> DataFrame:
    """Add the day column and sort by it. Files are sized by bytes: a busy day is split, small ones share a task."""
    instant, order = LAYOUT[table]
    day = day_column(table)
    return rows.withColumn(day, F.to_date(instant)).hint("rebalance", day).sortWithinPartitions(day, *order)


def append(rows: DataFrame, table: str, path: str) -> None:
    lay_out(rows, table).write.mode("append").partitionBy(day_column(table)).parquet(path)


def by_days(spark: SparkSession, table: str, path: str, schema: T.StructType) -> Versions:
    """A table with versions whose parts are its days."""
    instant, order = LAYOUT[table]
    schema = T.StructType([f for f in schema.fields if f.name != day_column(table)])
    return Versions(spark, path, schema, day_column(table), F.to_date(instant), T.DateType(), order)


def by_article(spark: SparkSession, table: str, path: str, schema: T.StructType, n: int = 64) -> Versions:
    """A table with versions in buckets of articles, for changes by key."""
    return Versions.buckets(spark, path, schema, ["article_id"], n, LAYOUT[table][1])


def create_days(rows: DataFrame, table: str, path: str) -> None:
    """The first version of a table kept by days."""
    by_days(rows.sparkSession, table, path, rows.schema).append(rows)


def read_days(spark: SparkSession, table: str, path: str, schema: T.StructType) -> DataFrame:
    """The newest version. Its folders are read as they are; the day column prunes them."""
    return by_days(spark, table, path, schema).read()


def replace_days(spark: SparkSession, kept: DataFrame, days: DataFrame, table: str, path: str, vacuum: bool = True) -> None:
    """A new version in which the days of ``days`` (column day) hold exactly the rows of ``kept``, which has no others.

    A day without kept rows leaves the table; other days keep their folders. Readers see the old version until the new
    one is committed; a second writer gets ``Conflict``. What only older versions had is deleted from disk afterwards,
    unless ``vacuum`` is false.
    """
    store = by_days(spark, table, path, kept.schema)
    base = store.snapshot()
    store.replace(kept, [str(r.day) for r in days.filter("day IS NOT NULL").collect()], base)  # at most a row a day
    if vacuum:
        store.vacuum(hours=0)
