"""Keyed streams whose state Spark keeps: politeness clocks, first arrivals, daily cells, expiry timers.

Each operator reduces its rows in parallel before they are dealt out by key, so a key with a third of all rows sends a few
rows from each task. State lives in Spark's RocksDB store below the checkpoint: it is restored after failures and restarts,
and every entry leaves by a time-out. Nothing is rewritten for keys that a micro-batch does not have. Results
go to tables with versions, which know the batches they have: a replayed batch is not written twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressgauge import settings
from pressgauge.operators.politeness import NO_FETCH, SLICE_DELAYS, decide, runs, sliced
from pressgauge.session import ship
from pressgauge.sources.versions import Versions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
COMPACT_EVERY = 20  # batches
HOUR_MS = 3_600_000
REFUSED = np.iinfo(np.int64).max // 2


@contextmanager
def settings_of(spark: SparkSession, **values: str):
    """Settings that a query takes when it starts; the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start(rows: DataFrame, store, checkpoint: str, by_event_time: bool) -> StreamingQuery:
    """Run over what there is. Time-outs of event time need a last batch without data; those of processing time would have
    such batches follow each other for ever, and are looked at when data come."""
    with settings_of(rows.sparkSession, **{PROVIDER: ROCKS, NO_DATA: str(by_event_time).lower()}):
        return (
            rows.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )


def once(table: Versions, name: str, batch_id: int, batch: DataFrame, write) -> None:
    """Run ``write`` unless the table has the batch. Its rows are worked out either way: that is what commits the state."""
    if table.has((name, batch_id)):
        batch.write.format("noop").mode("overwrite").save()
    else:
        write()
    tidy(table, batch_id)


def tidy(table: Versions, batch_id: int) -> None:
    """Every COMPACT_EVERY batches: gather parts that lie in many folders, delete what no version names."""
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        table.compact()
        table.vacuum()


# --- R4: politeness gate ---------------------------------------------------------


def chain_ends(times: np.ndarray, d: int) -> np.ndarray:
    """For each of the sorted times as a first fetch, the index of the last fetch of its chain.

    Chains are followed for all times at once, by doubling the length of the jumps.
    """
    n = len(times)
    up = np.append(np.searchsorted(times, times + d, side="left"), n)
    up[:n] = np.where(up[:n] >= n, np.arange(n), up[:n])  # an end points to itself
    while True:
        further = up[up]
        if (further == up).all():
            return up[:n]
        up = further


def slice_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(domain, slice, t, d, moves) of whole slices, in any order, to the steps of each slice's clock map."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    data = pd.concat(rows, ignore_index=True).sort_values(["domain", "slice", "t"], kind="stable", na_position="first")
    out = []
    for (domain, part), at in runs(data, ["domain", "slice"]):
        times, d = data["t"].to_numpy()[at], int(data["d"].to_numpy()[at][0])
        moving = np.unique(times[data["moves"].to_numpy()[at].astype(bool)])
        ends = chain_ends(moving, d)
        steps = np.flatnonzero(np.append(ends[1:] != ends[:-1], True)) if len(moving) else []
        upto = np.append(moving[steps], REFUSED)  # beyond the last fetch nothing moves
        clock = np.append(moving[ends[steps]], NO_FETCH)
        out.append(pd.DataFrame({
            "domain": np.repeat(domain, len(upto)), "slice": np.repeat(part, len(upto)), "d": np.repeat(d, len(upto)),
            "upto": upto, "clock": clock, "seen": np.repeat(times[-1], len(upto)),
        }))
    yield pd.concat(out, ignore_index=True)


def clock(slice_delays: int, keep_ms: int):
    """One clock a domain. Composes the maps of a micro-batch's slices and notes the clock that each slice starts with."""

    def step(key: tuple, maps: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        data = pd.concat(list(maps), ignore_index=True).sort_values(["slice", "upto"])
        now, timer = state.get if state.exists else (NO_FETCH, None)
        before, marks = now, []
        for (part,), at in runs(data, ["slice"]):
            d, upto, ends = (data[c].to_numpy()[at] for c in ("d", "upto", "clock"))
            marks.append((key[0], int(part), int(d[0]), now))
            after = int(ends[np.searchsorted(upto, now + int(d[0]), side="left")])
            now = now if after == NO_FETCH else after
        if now != before:
            # a slice that is not late has no request that this clock could refuse once the time is out
            timer = now // 1000 + max(keep_ms, int(data["d"].iloc[-1]) // 1000 * (slice_delays + 1)) + 1
            state.update((now, timer))
        if timer is not None:
            state.setTimeoutTimestamp(max(timer, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(marks, columns=["domain", "slice", "d", "clock"])

    return step


VERDICTS = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("polite", T.BooleanType())])


def verdicts(spark: SparkSession, path: str) -> Versions:
    return Versions.buckets(spark, path, VERDICTS, ["job_id"], 16)


def gate_stream(
    requests: DataFrame, path: str, checkpoint: str, slice_delays: int = SLICE_DELAYS, lateness: str = "1 hour", keep_hours: int = 24
) -> StreamingQuery:
    """Requests to verdicts, as the batch gate decides them, with one clock a domain as state.

    A domain's requests are cut into slices of time; each slice's effect on any clock is worked out where the slice is, as
    a step function. Only steps reach the domain's task, which composes them with the clock and says which clock each slice
    starts with; then slices decide their requests in parallel. A request before its domain's clock and delay have passed
    is refused and moves nothing, also one that comes out of order. Slices whose requests are all older than the watermark
    (``lateness`` behind the newest request) are refused. A clock is forgotten ``keep_hours`` after its fetch, or when no
    request that is not late could be refused by it, whichever is later.
    """
    spark = requests.sparkSession
    ship(spark)
    rows = sliced(requests, slice_delays)
    maps = rows.select("domain", "slice", "t", "d", "moves").repartition("domain", "slice").mapInPandas(
        slice_maps, "domain string, slice long, d long, upto long, clock long, seen long"
    )
    clocks = (
        maps.withColumn("seen", F.timestamp_micros("seen")).withWatermark("seen", lateness).groupBy("domain")
        .applyInPandasWithState(
            clock(slice_delays, keep_hours * HOUR_MS), "domain string, slice long, d long, clock long", "clock long, timer long",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )
    marks = clocks.select(
        "domain", F.lit(0).cast("long").alias("job_id"), F.col("clock").alias("t"), "d", F.lit(False).alias("moves"), "slice",
        F.lit(True).alias("is_clock"),
    )
    both = rows.withColumn("is_clock", F.lit(False)).select(*marks.columns).unionByName(marks)
    table = verdicts(spark, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        opened = batch.repartition("domain", "slice").sortWithinPartitions("domain", "slice", F.desc("is_clock"), "t", "job_id")
        decided = opened.mapInPandas(decide(REFUSED), "job_id long, polite boolean")
        once(table, "gate", batch_id, batch, lambda: table.append(decided, ("gate", batch_id)))

    return start(both, store, checkpoint, True)


# --- R2: first arrival by key ----------------------------------------------------


KEY_GROUPS = 4096  # a call of Python each, whatever the number of keys


def first_of(keys: list[str], order: str):
    """The first row of each key in a task's portion: what it sends on."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, more = [], 0
        for batch in batches:
            best, more = [*best, batch], more + len(batch)
            if more > len(best[0]):  # looked through when as many have come again
                best, more = [pd.concat(best, ignore_index=True).sort_values(order, kind="stable").drop_duplicates(keys)], 0
        if best and any(len(b) for b in best):
            yield pd.concat(best, ignore_index=True).sort_values(order, kind="stable").drop_duplicates(keys)

    return first


def first_seen(order: str, columns: list[str], keep_ms: int):
    """Lets the first row of a key pass, then none for as long as the key is remembered. One call has a group of keys, whose
    state is the keys and until when each is remembered."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        data, now = pd.concat(list(rows), ignore_index=True), state.getCurrentProcessingTimeMs()
        held = {k: until for k, until in zip(*state.get) if until > now} if state.exists else {}
        data = data[~data["key"].isin(held.keys())].sort_values(order).drop_duplicates("key")
        held |= dict.fromkeys(data["key"], now + keep_ms)
        state.update((list(held), list(held.values())))
        state.setTimeoutDuration(max(1, max(held.values()) - now))  # when the last of them is out
        if len(data):
            yield data[columns]

    return step


def first_arrivals(rows: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, keep_hours: float = 168, buckets: int = 64) -> StreamingQuery:
    """The first row of each key over the whole stream, by ``order`` within a micro-batch.

    State remembers keys for ``keep_hours`` after their arrival, so it has the keys of that time only (and those of their
    group until rows of that group come or the last of them is out). Keys are held in KEY_GROUPS groups by hash, as they
    are and not as hashes. The rows that pass, new keys and those forgotten, are looked up in the table: only in the
    buckets that they fall into, whose key columns are scanned and joined with the few that ask. So no key is ever too
    late, and what most micro-batches repeat never reaches the table.
    """
    spark, schema = rows.sparkSession, rows.schema
    ship(spark)
    named = rows.mapInPandas(first_of(keys, order), schema).withColumns({
        "key": F.to_json(F.struct(*keys)), "key_group": F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).cast("int"),
    })
    first = named.groupBy("key_group").applyInPandasWithState(
        first_seen(order, schema.names, int(keep_hours * HOUR_MS)), schema, "held array<string>, until array<long>", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    table = Versions.buckets(spark, path, schema, keys, buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        once(table, "first", batch_id, batch, lambda: table.append(table.missing(batch, keys), ("first", batch_id)))

    return start(first, store, checkpoint, False)


# --- R3: daily cells -------------------------------------------------------------

SUMS = ["n", "score", "scored", "magnitude", "measured"]
PARTIAL = "date string, sentiment_label string, n long, score double, scored long, magnitude double, measured long"
CELL = f"{PARTIAL}, since long"


def partial_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a task's events by day and label."""
    total = None
    for batch in batches:
        part = pd.DataFrame({
            "date": batch["date"], "sentiment_label": batch["sentiment_label"], "n": 1,
            "score": batch["sentiment_score"].astype(float).fillna(0.0), "scored": batch["sentiment_score"].notna().astype("int64"),
            "magnitude": batch["sentiment_magnitude"].astype(float).fillna(0.0), "measured": batch["sentiment_magnitude"].notna().astype("int64"),
        })
        total = part if total is None else pd.concat([total, part], ignore_index=True)
        total = total.groupby(["date", "sentiment_label"], dropna=False, as_index=False)[SUMS].sum()
    if total is not None and len(total):
        yield total


def cell(keep_ms: int):
    """Running sums of one (day, label), and since when they run."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        more = [sum(x) for x in zip(*[b[SUMS].sum().tolist() for b in rows])]
        # the start is the same when a batch is run again after a failure, and later for a cell that starts anew
        now = state.getCurrentProcessingTimeMs()
        old = state.get if state.exists and state.get[6] > now else (0, 0.0, 0, 0.0, 0, now, now)
        new = [kind(a + b) for kind, a, b in zip((int, float, int, float, int), old, more)]
        state.update((*new, int(old[5]), now + keep_ms))
        state.setTimeoutDuration(max(1, keep_ms))
        yield pd.DataFrame([(key[0], key[1], *new, int(old[5]))], columns=["date", "sentiment_label", *SUMS, "since"])

    return step


def trend_cells(spark: SparkSession, path: str) -> Versions:
    schema = T.StructType.fromDDL(CELL)
    return Versions.buckets(spark, path, schema, ["date", "sentiment_label"], 16)


def trend_stream(events: DataFrame, path: str, checkpoint: str, keep_hours: float = 48) -> StreamingQuery:
    """Daily trend over tumbling days of event time.

    A day's cell leaves the state ``keep_hours`` after its last event came; an event that comes later starts a new cell
    of that day beside the stored one, and the table adds them up. So state has the days that are still being written to,
    and no event is dropped however late it is. Each batch replaces just the cells that it changed.
    """
    ship(events.sparkSession)
    narrow = events.select(F.date_format("ingested_at", "yyyy-MM-dd").alias("date"), "sentiment_label", "sentiment_score", "sentiment_magnitude")
    cells = narrow.mapInPandas(partial_cells, PARTIAL).groupBy("date", "sentiment_label").applyInPandasWithState(
        cell(int(keep_hours * HOUR_MS)), CELL, "n long, score double, scored long, magnitude double, measured long, since long, until long",
        "append", GroupStateTimeout.ProcessingTimeTimeout,
    )
    table = trend_cells(events.sparkSession, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        # null labels are no keys of a join
        named = batch.withColumn("sentiment_label", F.coalesce("sentiment_label", F.lit("")))
        once(table, "trend", batch_id, batch, lambda: table.merge(named, ["date", "sentiment_label", "since"], batch=("trend", batch_id)))

    return start(cells, store, checkpoint, False)


def trend_table(spark: SparkSession, path: str) -> DataFrame:
    """The trend so far."""
    cells = trend_cells(spark, path).read().withColumn("sentiment_label", F.nullif("sentiment_label", F.lit("")))
    sums = cells.groupBy(F.col("date").cast("date").alias("date"), "sentiment_label").agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.select(
        "date", "sentiment_label", F.col("n").alias("article_count"),
        F.try_divide("score", "scored").alias("avg_sentiment_score"), F.try_divide("magnitude", "measured").alias("avg_magnitude"),
    )


# --- R5: expiry of contents ------------------------------------------------------


def expiry_stream(
    contents: DataFrame, store: Versions, checkpoint: str, ttl_hours: int = settings.CONTENT_TTL_HOURS, lateness_hours: float = 0
) -> StreamingQuery:
    """Delete contents from ``store`` (buckets by article_id) as they expire by the stream's own clock.

    The clock is the newest extraction, less ``lateness_hours``. State has an entry for each article and expiry, which leaves
    it when the watermark reaches the expiry; then the row of that expiry goes, so a newer one of the article stays. A content
    that has already expired by the clock when it comes gets no entry (Spark drops it as late); it is deleted with its own batch.
    """
    micros = F.unix_micros(F.col("expires_at").cast("timestamp"))
    rows = contents.select("article_id", micros.alias("expires"), F.col("expires_at").cast("timestamp").alias("due"))
    timed = rows.withWatermark("due", f"{int((ttl_hours + lateness_hours) * 3600)} seconds").groupBy("due", "article_id").agg(
        F.max("expires").alias("expires")
    ).select("article_id", "expires")
    both = timed.withColumn("fired", F.lit(True)).unionByName(rows.select("article_id", "expires", F.lit(False).alias("fired")))

    def sweep(batch: DataFrame, batch_id: int) -> None:
        def delete() -> None:
            rows = store.settled(batch)  # read twice
            newest = rows.where("NOT fired").agg(F.max("expires")).first()[0]
            clock = max(store.snapshot().batches.get("expiry clock", -1), (newest or 0) - int((ttl_hours + lateness_hours) * 3_600_000_000))
            gone = rows.where(F.col("fired") | (F.col("expires") <= clock)).select("article_id", "expires").distinct()
            gone = gone.select("article_id", F.timestamp_micros("expires").cast("timestamp_ntz").alias("expires_at"))
            store.merge(gone, ["article_id", "expires_at"], "delete", batch=("expiry", batch_id), notes={"expiry clock": clock})

        once(store, "expiry", batch_id, batch, delete)

    return start(both, sweep, checkpoint, True)
