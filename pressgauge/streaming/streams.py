"""Structured Streaming twins of the batch operators.

Sinks are idempotent per micro-batch: a batch that is replayed after a failure
overwrites its own folder, or is found in the table's log and not written again.
What is decided by key has its state in ``stateful``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from pressgauge.operators.ingest import ingest_new_articles
from pressgauge.operators.normalize import clean_feed
from pressgauge.operators.politeness import SLICE_DELAYS
from pressgauge.operators.sentiment import lexicon_scores
from pressgauge.schemas import RAW_FEED
from pressgauge.sources.events import event_table
from pressgauge.sources.feeds import raw_feed
from pressgauge.sources.versions import Versions
from pressgauge.streaming.stateful import first_arrivals, gate_stream, tidy, trend_stream, trend_table, verdicts

__all__ = [
    "dedup_stream", "drain", "event_sink_stream", "first_items", "ingest_stream", "politeness_stream", "politeness_verdicts",
    "trend_stream", "trend_table",
]


def drain(query: StreamingQuery) -> None:
    """Wait for an availableNow query to end; its error, if any, is raised."""
    query.awaitTermination()


def _stored(spark: SparkSession, path: str, but: int) -> DataFrame | None:
    """Rows of all batches except ``but`` (left over from a failed try), or None before the first one."""
    try:
        return spark.read.parquet(path).filter(F.col("batch") != but)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest_stream(
    responses: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, known_urls: DataFrame | None = None, score=lexicon_scores
) -> StreamingQuery:
    """Feed responses to stored articles: normalise, first wins per url, only urls not stored yet."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _stored(spark, path, batch_id)
        urls = [df.select("url") for df in (stored, known_urls) if df is not None]
        if not urls:
            urls = [spark.createDataFrame([], "url string")]
        known = urls[0] if len(urls) == 1 else urls[0].unionByName(urls[1])
        _write_batch(ingest_new_articles(raw_feed(batch), known, lexicon, score), path, batch_id)

    return (
        responses.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def dedup_stream(responses: DataFrame, path: str, checkpoint: str, keep_hours: float = 168) -> StreamingQuery:
    """Normalised items, the first of each (url, source) over the whole stream, with all their columns.

    Within a micro-batch the smallest arrival number is first, so it does not matter how responses fall into tasks.
    """
    return first_arrivals(clean_feed(raw_feed(responses)), ["url", "source_name"], "ingest_seq", path, checkpoint, keep_hours)


def first_items(spark: SparkSession, path: str) -> DataFrame:
    """What ``dedup_stream`` has stored."""
    schema = clean_feed(spark.createDataFrame([], RAW_FEED)).schema
    return Versions.buckets(spark, path, schema, ["url", "source_name"]).read().select(*schema.names)


def event_sink_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once event log by days: one row per event id over all batches; a replayed batch is not written again."""
    table = event_table(events.sparkSession, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        if not table.has(("events", batch_id)):
            # Repeats carry their original instant, so only the days of this batch are looked up.
            table.append(table.missing(batch.dropDuplicates(["event_id"]), ["event_id"]), ("events", batch_id))
        tidy(table, batch_id)

    return (
        events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def politeness_stream(requests: DataFrame, path: str, checkpoint: str, slice_delays: int = SLICE_DELAYS) -> StreamingQuery:
    """Requests to verdicts; ``politeness_verdicts`` reads them."""
    return gate_stream(requests, path, checkpoint, slice_delays)


def politeness_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return verdicts(spark, path).read().select("job_id", "polite")
