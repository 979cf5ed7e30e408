"""Keyed streams: over many batches, restarts and replays they equal the batch operators, and their state stays bounded."""

import datetime as dt
import json
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_crawl import frame, scan

from pressgauge.operators import content
from pressgauge.operators.normalize import clean_feed, dedup_feed
from pressgauge.sources import feeds, tables
from pressgauge.streaming import stateful, streams

NOW = dt.datetime(2025, 11, 20, 12)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def state_rows(query):
    """Rows in the state store after the last batch that reported any."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in map(lambda x: json.loads(x.json), query.recentProgress) if p["stateOperators"]]


def test_chain_ends():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400):
        times = np.unique(rng.integers(0, n * 3 + 1, n))
        for d in (1, 5, 40):
            want = []
            for i in range(len(times)):
                last = i
                while (j := int(np.searchsorted(times, times[last] + d))) < len(times):
                    last = j
                want.append(last)
            assert stateful.chain_ends(times, d).tolist() == want


@pytest.mark.parametrize("slice_delays", [2, 4096])
def test_gate_over_batches_with_restarts(spark, tmp_path, slice_delays):
    """Each batch is a run of its own: the clocks come back from the checkpoint."""
    rng = random.Random(slice_delays)
    requests = sorted(
        [(rng.choices(["hot", "b", "c"], [8, 1, 1])[0], i, round(rng.random() * 400, 1), 3.0, rng.random() < 0.8) for i in range(1500)], key=lambda r: (r[2], r[1])
    )
    for part in range(3):
        frame(spark, requests[part * 500 : (part + 1) * 500]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(spark, requests[:1]).schema).parquet(str(tmp_path / "in"))
        query = stateful.gate_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), slice_delays)
        streams.drain(query)
        assert max(state_rows(query)) <= 3  # a clock for each domain
    got = [tuple(r) for r in streams.politeness_verdicts(spark, str(tmp_path / "out")).collect()]
    assert len(got) == 1500 and dict(got) == scan(requests)


def test_gate_refuses_what_comes_too_late_and_forgets_old_clocks(spark, tmp_path):
    def run(*requests):
        frame(spark, requests).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(spark, requests).schema).parquet(str(tmp_path / "in"))
        query = stateful.gate_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2, "10 seconds", 1)
        streams.drain(query)
        return dict(tuple(r) for r in streams.politeness_verdicts(spark, str(tmp_path / "out")).collect()), state_rows(query)[-1]

    got, _ = run(("a", 1, 100.0, 3.0, True), ("b", 2, 100.0, 3.0, True))
    assert got == {1: True, 2: True}
    got, _ = run(("a", 3, 99.0, 3.0, True), ("a", 4, 101.0, 3.0, True), ("b", 5, 5000.0, 3.0, True))
    assert got[3] is False and got[4] is False and got[5] is True
    got, left = run(("a", 6, 200.0, 3.0, True), ("c", 7, 5001.0, 3.0, True))
    assert got[6] is False and got[7] is True  # older than the watermark
    got, left = run(("a", 8, 9000.0, 3.0, True))
    assert got[8] is True
    got, left = run(("a", 9, 20000.0, 3.0, True))
    assert got[9] is True and left <= 1  # b's and c's clocks have gone


def responses(spark, folder, batches):
    folder.mkdir(exist_ok=True)
    for n, urls in batches:
        data = [{"title": f"t{n}.{i}", "description": "d", "url": u, "published_at": "2025-11-18"} for i, u in enumerate(urls)]
        (folder / f"{n:03d}.json").write_text(json.dumps({"payload_seq": n, "source_name": "ab"[n % 2], "payload": json.dumps({"data": data})}))


def test_dedup_over_batches_with_restarts(spark, tmp_path):
    """Six batches in two runs, most urls repeated: what is stored is what the batch keeps."""
    rng = random.Random(3)
    log = tmp_path / "log"
    for run in range(2):
        responses(spark, log, [(run * 3 + k, ["https://e.com/hot"] * 20 + [f"https://e.com/{rng.randrange(60)}" for _ in range(30)]) for k in range(3)])
        query = streams.dedup_stream(feeds.stream_responses(spark, str(log), 1), str(tmp_path / "out"), str(tmp_path / "cp"))
        streams.drain(query)
        assert max(state_rows(query)) <= 122
    got = sorted((r.ingest_seq, r.url, r.title) for r in streams.first_items(spark, str(tmp_path / "out")).collect())
    want = dedup_feed(clean_feed(feeds.raw_feed(feeds.read_responses(spark, str(log)))))
    assert got == sorted((r.ingest_seq, r.url, r.title) for r in want.collect())


def test_dedup_forgets_keys_but_stays_exact(spark, tmp_path):
    """Keys are remembered for a moment only: state stays small over twelve batches, and repeats are found in the table."""
    log = tmp_path / "log"
    responses(spark, log, [(n, [f"https://e.com/{n}/{i}" for i in range(10)] + ["https://e.com/0/0", "https://e.com/0/1"]) for n in range(0, 24, 2)])
    query = streams.dedup_stream(feeds.stream_responses(spark, str(log), 1), str(tmp_path / "out"), str(tmp_path / "cp"), keep_hours=0.2 / 3600)
    streams.drain(query)
    rows = state_rows(query)
    assert len(rows) == 12 and max(rows) <= 48  # of 120 keys
    got = streams.first_items(spark, str(tmp_path / "out")).collect()
    assert len(got) == 120 and {r.ingest_seq for r in got if r.url == "https://e.com/0/0"} == {0}


EVENTS = "ingested_at timestamp_ntz, sentiment_label string, sentiment_score double, sentiment_magnitude double"


def trend_of(frame):
    rows = frame.groupBy(F.to_date("ingested_at").alias("date"), "sentiment_label").agg(
        F.count("*").alias("n"), F.round(F.avg("sentiment_score"), 9).alias("s"), F.round(F.avg("sentiment_magnitude"), 9).alias("m"))
    return {(r.date, r.sentiment_label): (r.n, r.s, r.m) for r in rows.collect()}


def stored_trend(spark, path):
    rows = streams.trend_table(spark, path).collect()
    near = lambda x: None if x is None else round(x, 9)
    assert len({(r.date, r.sentiment_label) for r in rows}) == len(rows)
    return {(r.date, r.sentiment_label): (r.article_count, near(r.avg_sentiment_score), near(r.avg_magnitude)) for r in rows}


@pytest.mark.parametrize("keep_hours", [48, 0])
def test_trend_over_batches(spark, tmp_path, keep_hours):
    """On time, late, very late, without label or score; cells that state has forgotten start anew beside the stored ones."""
    rng = random.Random(6)
    folder, seen = str(tmp_path / "in"), 0
    for run in range(3):
        rows = [(NOW + run * DAY - rng.choice([0, 1, 1, 90]) * DAY, rng.choice(["positive", "negative", None]), rng.choice([None, 0.5, -0.25]), rng.choice([None, 1.5])) for _ in range(60)]
        spark.createDataFrame(rows, EVENTS).repartition(2).write.mode("append").parquet(folder)
        query = streams.trend_stream(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder), str(tmp_path / "out"), str(tmp_path / "cp"), keep_hours or 1e-6)
        streams.drain(query)
        seen = max(seen, *state_rows(query))
        assert stored_trend(spark, str(tmp_path / "out")) == trend_of(spark.read.parquet(folder))
    cells = stateful.trend_cells(spark, str(tmp_path / "out"))
    if keep_hours:  # a row a cell, however many batches
        assert cells.read().count() == len(stored_trend(spark, str(tmp_path / "out"))) >= seen
    else:
        assert cells.read().count() > len(stored_trend(spark, str(tmp_path / "out"))) and seen <= 12


def test_replayed_trend_batch(spark, tmp_path):
    """The last batch's commit is lost after its results were stored: it runs again and counts nothing twice."""
    folder = str(tmp_path / "in")

    def run():
        streams.drain(streams.trend_stream(spark.readStream.schema(EVENTS).parquet(folder), str(tmp_path / "out"), str(tmp_path / "cp")))

    for n in range(3):
        spark.createDataFrame([(NOW, "positive", float(n), None)] * 5, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        run()
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    shutil.copytree(tmp_path / "out", tmp_path / "before")
    run()
    assert stored_trend(spark, str(tmp_path / "out")) == trend_of(spark.read.parquet(folder)) == {(NOW.date(), "positive"): (15, 1.0, None)}
    spark.createDataFrame([(NOW, "positive", 9.0, None)], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert stored_trend(spark, str(tmp_path / "out")) == trend_of(spark.read.parquet(folder))


def test_expiry_equals_cleanup_at_each_clock(spark, tmp_path):
    """Contents come day by day, some again before they expire, some late, some already expired."""
    rng = random.Random(1)
    store, latest, clock = None, {}, None
    folder = str(tmp_path / "in")
    for day in range(9):
        at = NOW + day * DAY
        rows = [(rng.randrange(40), f"text {day} {i}", at - rng.choice([0, 1, 30, 400]) * HOUR) for i in range(8)] + [(1000 + day, "x", at)]
        rows = list({r[0]: r for r in rows if r[2] > latest.get(r[0], (None, dt.datetime.min))[1]}.values())
        new = content.content_store(spark.createDataFrame(rows, "article_id long, text string, extracted_at timestamp_ntz"))
        if store is None:
            store = tables.by_article(spark, "article_contents", str(tmp_path / "store"), new.schema, 8)
        store.merge(new, ["article_id"])
        latest.update({r[0]: r[1:] for r in rows})
        clock = max(clock or at, *(r[2] for r in rows))
        new.coalesce(1).write.mode("append").parquet(folder)
        query = stateful.expiry_stream(spark.readStream.schema(new.schema).parquet(folder), store, str(tmp_path / "cp"))
        streams.drain(query)
        left = {r.article_id: r.content_hash for r in store.read().collect()}
        want = {k for k, (_, t) in latest.items() if t + 7 * DAY > clock}
        assert set(left) == want, day
        assert max(state_rows(query)) <= 60
    store.vacuum(hours=0)
    files = list((tmp_path / "store").rglob("*.parquet"))
    assert {r.article_id for f in files for r in spark.read.parquet(str(f)).collect()} == want  # expired texts are off the disk


class OneState:
    """A group's state and clock by hand."""

    hasTimedOut, value = False, None

    def __init__(self, now):
        self.now = now

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_one_call_lets_the_first_rows_of_many_keys_pass():
    step, state = stateful.first_seen("n", ["n", "url"], 100), OneState(1000)

    def arrive(rows):
        data = pd.DataFrame(rows, columns=["n", "url", "key"])
        return [tuple(r) for frame in step((7,), iter([data[:1], data[1:]]), state) for r in frame.itertuples(index=False)]

    assert arrive([(n, f"u{n % 50}", f"k{n % 50}") for n in reversed(range(200))]) == [(n, f"u{n}") for n in range(50)]
    state.now = 1050
    assert arrive([(300, "u3", "k3"), (301, "v", "new")]) == [(301, "v")] and len(state.get[0]) == 51 and state.timeout == 100
    state.now = 1120  # all but the new one are forgotten
    assert arrive([(400, "u3", "k3"), (401, "v", "new")]) == [(400, "u3")] and sorted(state.get[0]) == ["k3", "new"]
    state.hasTimedOut = True
    assert arrive([]) == [] and not state.exists


def test_first_rows_of_a_task_are_not_sorted_again_for_each_batch(monkeypatch):
    batches, sorted_rows = [pd.DataFrame({"n": range(k * 10, k * 10 + 10), "url": [f"u{i % 400}" for i in range(k * 10, k * 10 + 10)]}) for k in range(64)], []
    real = pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *args, **more: sorted_rows.append(len(self)) or real(self, *args, **more))
    got = pd.concat(stateful.first_of(["url"], "n")(iter(batches)))
    assert got["n"].tolist() == list(range(400)) and sum(sorted_rows) <= 5 * 640


def test_expiry_state_needs_no_call_for_an_article(spark, tmp_path):
    """The state of expiries is Spark's own aggregation; contents leave it as they expire."""
    new = content.content_store(spark.createDataFrame([(i, f"t{i}", NOW - (i % 2) * 5 * DAY) for i in range(200)], "article_id long, text string, extracted_at timestamp_ntz"))
    store = tables.by_article(spark, "article_contents", str(tmp_path / "store"), new.schema, 4)
    store.append(new)
    for rows in (new, content.content_store(spark.createDataFrame([(500, "x", NOW + 3 * DAY)], "article_id long, text string, extracted_at timestamp_ntz"))):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stateful.expiry_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp"))
        streams.drain(query)
        assert {o["operatorName"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"]} == {"stateStoreSave"}
    assert sorted(r.article_id for r in store.read().collect()) == list(range(0, 200, 2)) and state_rows(query)[-1] == 101
