"""Read queries: newest rows, lookups, nested responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pressgauge.functions.text import digest_number


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with the nested source {id, name}; Spark broadcasts the dimension while it is small by bytes."""
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"))
    joined = articles.join(dim, "source_id", "left")
    return joined.withColumn("source", F.struct(F.col("source_id").alias("id"), F.col("_name").alias("name"))).drop("_name")


def article_read(articles: DataFrame, sources: DataFrame) -> DataFrame:
    return with_source(articles, sources).select(
        "id", "title", "description", "url", "image_url", "published_at", "language", "country", "category",
        "source", "sentiment_label", "sentiment_score",
    )


def article_by_id(articles: DataFrame, article_id: int) -> DataFrame:
    return articles.filter(F.col("id") == article_id)


def latest_articles(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first; TakeOrderedAndProject, id breaks ties."""
    return articles.orderBy(F.desc("published_at"), "id").limit(limit)


def latest_with_analyses(articles: DataFrame, sources: DataFrame, analyses: DataFrame, limit: int = 40) -> DataFrame:
    """The newest articles with all their analyses, one row per analysis.

    The limit counts articles: it is taken first, and its at most ``limit`` rows
    are broadcast to the analyses, which therefore never move.
    """
    top = with_source(latest_articles(articles, limit), sources)
    detail = analyses.select(
        F.col("id").alias("analysis_id"), F.col("article_id").alias("id"), "provider", "score", "magnitude", "label"
    )
    found = detail.join(F.broadcast(top.select("id")), "id", "left_semi")
    return top.join(found, "id", "left")


def pending_jobs(jobs: DataFrame, limit: int | None = 10) -> DataFrame:
    """Oldest PENDING jobs first."""
    waiting = jobs.filter(F.col("status") == "PENDING")
    return waiting.orderBy("created_at", "id").limit(limit) if limit is not None else waiting


def user_bookmarks(bookmarks: DataFrame, articles: DataFrame, user_id: int) -> DataFrame:
    mine = bookmarks.filter(F.col("user_id") == user_id)
    return mine.join(articles.withColumnRenamed("id", "article_id"), "article_id")


def sources_with_articles(
    sources: DataFrame, articles: DataFrame, per_row: int = 1000, unique: str = "id"
) -> DataFrame:
    """Sources with their article ids as sorted lists of bounded length.

    A source may own most of the articles, so its list comes in parts: ids are
    spread over ceil(n / per_row) parts by a digest of the ``unique`` column (ids may be
    regular), n counted beforehand on (source, count) rows. A source without articles has one
    empty part.
    """
    counts = articles.groupBy("source_id").agg(F.count("*").alias("n_articles"))
    dim = sources.select(F.col("id").alias("source_id"), "name").join(counts, "source_id", "left")
    dim = dim.withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    dim = dim.withColumn("parts", F.greatest(F.ceil(F.col("n_articles") / per_row), F.lit(1)).cast("long"))
    keyed = articles.select("source_id", "id", F.col(unique).alias("_unique")).join(dim.select("source_id", "parts"), "source_id")
    lists = keyed.groupBy("source_id", F.pmod(digest_number(F.col("_unique")), F.col("parts")).alias("part")).agg(
        F.sort_array(F.collect_list("id")).alias("article_ids")
    )
    return dim.drop("parts").join(lists, "source_id", "left").select(
        "source_id", "name", "n_articles", F.coalesce("part", F.lit(0)).cast("long").alias("part"),
        F.coalesce("article_ids", F.array().cast("array<bigint>")).alias("article_ids"),
    )


def users_with_bookmarks(users: DataFrame, bookmarks: DataFrame, per_row: int = 1000) -> DataFrame:
    """Users with their bookmarked article ids, in parts like ``sources_with_articles``."""
    owned = bookmarks.select(F.col("user_id").alias("source_id"), F.col("article_id").alias("id"), F.col("id").alias("bookmark_id"))
    lists = sources_with_articles(users.select("id", F.col("email").alias("name")), owned, per_row, "bookmark_id")
    return lists.select(
        F.col("source_id").alias("id"), F.col("name").alias("email"), F.col("n_articles").alias("n_bookmarks"),
        "part", F.col("article_ids").alias("bookmarks"),
    )


def latest_sentiment(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each article. The rank limit drops older ones before the exchange."""
    newest = Window.partitionBy("article_id").orderBy(F.desc("analyzed_at"), F.desc("id"))
    ranked = analyses.select("article_id", "id", "label", "score", "provider", "analyzed_at")
    return ranked.withColumn("rank", F.row_number().over(newest)).filter("rank <= 1").drop("rank")


def article_sentiment_update(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    """Articles with label and score overwritten by their newest analysis, if any."""
    new = latest_sentiment(analyses).select(
        F.col("article_id").alias("id"), F.col("label").alias("_label"), F.col("score").alias("_score")
    )
    return articles.join(new, "id", "left").withColumns({
        "sentiment_label": F.coalesce("_label", "sentiment_label"),
        "sentiment_score": F.coalesce("_score", "sentiment_score"),
    }).drop("_label", "_score")
