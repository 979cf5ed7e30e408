"""The ingestion run on stored tables: counts, replay, a run that breaks off, and the crawl run on what it stored."""

import datetime as dt
import json

import pytest

from pressgauge.operators import crawl_stored, ingest_stored, sentiment

NOON = dt.datetime(2025, 11, 20, 12)


def responses(spark, items_by_source):
    rows = [(i, name, None if items is None else json.dumps({"data": items})) for i, (name, items) in enumerate(items_by_source)]
    return spark.createDataFrame(rows, "payload_seq long, source_name string, payload string")


def item(n, when="2025-11-20T10:00:00+00:00"):
    return {"title": f"good news {n}", "description": f"text {n}", "url": f"https://h{n}.org/a", "published_at": when}


def test_ingestion_run_and_replay(spark, tmp_path, monkeypatch):
    stores = ingest_stored.open_tables(spark, str(tmp_path), 2)
    lexicon = sentiment.default_lexicon(spark)
    first = responses(spark, [("b", [item(1), item(1), item(2, "soon")]), ("a", [item(1), item(3)]), ("c", None)])
    real = ingest_stored.Versions.merge

    def lost(self, *args, **more):
        if self is stores["articles"]:
            raise OSError("lost")
        return real(self, *args, **more)

    with monkeypatch.context() as m:
        m.setattr(ingest_stored.Versions, "merge", lost)
        with pytest.raises(OSError):
            ingest_stored.stored_ingest_run(stores, first, lexicon, NOON)
    assert stores["articles"].read().count() == 0 and stores["sources"].read().count() == 2
    counts = ingest_stored.stored_ingest_run(stores, first, lexicon, NOON)
    assert counts == {"responses": 3, "failed_responses": 1, "items": 5, "undated_items": 1, "new_sources": 2, "new_articles": 2}
    version = stores["articles"].snapshot().version
    assert ingest_stored.stored_ingest_run(stores, first, lexicon, NOON) == counts and stores["articles"].snapshot().version == version

    second = responses(spark, [("a", [item(3), item(4)])])
    later = ingest_stored.stored_ingest_run(stores, second, lexicon, NOON + dt.timedelta(hours=1))
    assert (later["new_articles"], later["new_sources"], later["items"]) == (1, 0, 2)
    names = {r.id: r.name for r in stores["sources"].read().collect()}
    got = {r.url: names[r.source_id] for r in stores["articles"].read().collect()}
    assert got == {"https://h1.org/a": "b", "https://h3.org/a": "a", "https://h4.org/a": "a"}

    # An empty run changes no rows; the crawl run opens the same tables.
    empty = ingest_stored.stored_ingest_run(stores, first.limit(0), lexicon, NOON + dt.timedelta(hours=2))
    assert set(empty.values()) == {0} and stores["articles"].read().count() == 3
    assert crawl_stored.stored(crawl_stored.open_tables(spark, str(tmp_path), 2)["articles"]).count() == 3
