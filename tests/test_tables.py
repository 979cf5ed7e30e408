"""Ingest, validation, content, retention, reads and sinks on small fixtures."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pressgauge.operators import analytics, content, ingest, normalize, reads, retention, sentiment, validate
from pressgauge.schemas import FEED_ITEM, RAW_FEED
from pressgauge.sources import events, feeds, tables
from pressgauge.streaming import streams

NOW = dt.datetime(2025, 11, 20, 12)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def item(seq, source, **kw):
    base = dict.fromkeys(f.name for f in FEED_ITEM.fields)
    base.update(title="Good title", description="text", url="https://e.com/a", published_at="2025-11-18T10:30:00Z", language="en", category="general")
    base.update(kw)
    return (seq, source, *[base[f.name] for f in FEED_ITEM.fields])


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_FEED)


def test_normalize_and_ingest(spark):
    feed = raw(
        spark,
        item(1, "a", url="https://e.com/x?utm=1#f", image="", image_url="https://i/p.png"), item(2, "a", url="https://e.com/x?utm=2"),
        item(3, "b", url="https://e.com/x"), item(4, "a", title="  "), item(5, "a", description=None), item(6, "a", url=None),
        item(7, "a", url="https://e.com/late", published_at="soon"), item(8, "b", url="https://e.com/late"), item(9, "a", url="https://e.com/old"),
    )
    words = sentiment.default_lexicon(spark)
    rows = {r.ingest_seq: r for r in normalize.normalize_articles(feed, words).collect()}
    assert set(rows) == {1, 3, 7, 8, 9}
    assert rows[1].url == "https://e.com/x" and rows[1].image_url == "https://i/p.png"
    assert rows[1].sentiment_label == "positive" and isinstance(rows[1].sentiment_score, float)
    assert rows[7].published_at is None

    stored = spark.createDataFrame([("https://e.com/old",)], "url string")
    new = ingest.ingest_new_articles(feed, stored, words)
    found = {r.url: r.id for r in new.select("id", "url").collect()}
    assert set(found) == {"https://e.com/x", "https://e.com/late"} and len(set(found.values())) == 2
    again = ingest.ingest_new_articles(feed, stored.unionByName(new.select("url")), words)
    assert again.count() == 0
    # ids come from the urls: a numbering that starts anew gives the same
    anew = ingest.ingest_new_articles(feed.withColumn("ingest_seq", F.col("ingest_seq") + 100), stored, words)
    assert {r.url: r.id for r in anew.select("url", "id").collect()} == found
    dim = spark.createDataFrame([(5, "a", NOW, NOW)], "id long, name string, created_at timestamp_ntz, updated_at timestamp_ntz")
    rows, after = ingest.ingest(feed, stored, dim, words, NOW)
    names = {r.name: r.id for r in after.collect()}
    assert names["a"] == 5 and {r.url: r.source_id for r in rows.collect()} == {"https://e.com/x": 5, "https://e.com/late": names["b"]}
    assert [r.ingest_seq for r in ingest.undated(normalize.clean_feed(feed)).collect()] == [7]


def test_hot_url(spark):
    """One url makes up most of the feed; the first arrival wins."""
    feed = raw(spark, *[item(i, f"s{i % 3}", url="https://e.com/hot" if i % 10 else f"https://e.com/{i}") for i in range(1, 600)])
    clean = normalize.clean_feed(feed)
    kept = ingest.first_new_urls(clean, spark.createDataFrame([], "url string"))
    assert {r.ingest_seq for r in kept.collect()} == {1, *range(10, 600, 10)}


def test_sources(spark):
    stored = spark.createDataFrame([(1, "bbc", NOW, NOW)], "id long, name string, created_at timestamp_ntz, updated_at timestamp_ntz")
    names = spark.createDataFrame([("bbc",), ("dw",), ("dw",)], "source_name string")
    after = ingest.upsert_sources(names, stored, NOW)
    assert sorted(r.name for r in after.collect()) == ["bbc", "dw"]
    assert ingest.new_sources(names, after, NOW).count() == 0
    assert [r.source_name for r in ingest.rejected_sources(names, stored).collect()] == ["bbc"]
    got = {r.name: (r.normalized, list(r.violations)) for r in validate.validate_sources(
        spark.createDataFrame([(" BBC ",), ("Test Source",), ("  ",), ("",)], "name string")).collect()}
    assert got[" BBC "] == ("bbc", []) and got["Test Source"][1] == ["name_has_space"]
    assert got["  "][1] == ["name_blank"] and got[""][1] == ["name_missing"]


def test_validation(spark):
    good = dict(title="t", description="d", url="https://e.com/a", image_url=None, published_at=NOW, language="en", country="gb",
                category="c", sentiment_label="neutral", sentiment_score=0.0)
    cases = [
        ({}, []), ({"title": "  "}, ["title_blank"]), ({"title": "x" * 256}, ["title_too_long"]), ({"description": "x" * 1001}, ["description_too_long"]),
        ({"url": "nope"}, ["url_invalid"]), ({"image_url": "ftp://x"}, ["image_url_invalid"]), ({"image_url": ""}, []), ({"language": "eng"}, ["language_length"]),
        ({"country": "g"}, ["country_length"]), ({"category": "x" * 51}, ["category_too_long"]), ({"sentiment_label": "meh"}, ["label_unknown"]),
        ({"sentiment_score": 1.1}, ["score_out_of_range"]), ({"published_at": None, "language": None}, ["published_at_missing"]),
    ]
    schema = ("i int, title string, description string, url string, image_url string, published_at timestamp_ntz, language string, "
              "country string, category string, sentiment_label string, sentiment_score double")
    df = spark.createDataFrame([(i, *{**good, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    checked = validate.validate_articles(df)
    got = {r.i: list(r.violations) for r in checked.collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert validate.valid(checked).count() == 2 and validate.quarantined(checked).count() == len(cases) - 2


def contents(spark):
    texts = [(1, "x" * 5000, NOW - 2 * HOUR), (2, "y", NOW - 6 * DAY), (3, "z", NOW - 7 * DAY), (4, "é", NOW - 10 * DAY)]
    return content.content_store(spark.createDataFrame(texts, "article_id long, text string, extracted_at timestamp_ntz"))


def test_content(spark):
    import hashlib

    stored = contents(spark)
    first = stored.filter("article_id = 1").first()
    assert (len(first.content_text), first.content_length) == (1024, 5000)
    assert first.content_hash == hashlib.sha256(b"x" * 5000).hexdigest() and first.expires_at == NOW - 2 * HOUR + 7 * DAY
    assert {r.article_id for r in content.ttl_cleanup(stored, NOW).collect()} == {1, 2}
    stats = content.content_statistics(stored, NOW).first()
    assert (stats.total_records, stats.active_records, stats.expired_records) == (4, 2, 2)
    assert content.content_statistics(stored.filter("1 = 0"), NOW).first().average_content_length == 0
    new = content.content_store(spark.createDataFrame([(2, "new", NOW), (9, "n", NOW)], "article_id long, text string, extracted_at timestamp_ntz"))
    after = {r.article_id: r.content_text for r in content.content_upsert(stored, new).collect()}
    assert len(after) == 5 and after[2] == "new" and after[9] == "n"


def test_job_retention(spark):
    rows = []
    for i, status in enumerate(["SUCCESS", "FAILED", "FORBIDDEN_BY_ROBOTS", "PENDING", "IN_PROGRESS", "RATE_LIMITED"]):
        rows += [(i * 2, status, NOW - 7 * DAY), (i * 2 + 1, status, NOW - 8 * DAY)]
    jobs = spark.createDataFrame(rows, "id long, status string, created_at timestamp_ntz")
    assert {r.id for r in retention.old_crawl_jobs(jobs, NOW).collect()} == {1, 3, 5}
    assert retention.crawl_job_retention(jobs, NOW).count() == 9


def test_cascade(spark):
    child = spark.createDataFrame([(1, 10), (2, 20)], "id long, article_id long")
    stored = {
        "sources": spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"),
        "articles": spark.createDataFrame([(10, 1), (20, 2)], "id long, source_id long"), **{n: child for n in retention.CHILDREN},
    }
    keys = lambda i: spark.createDataFrame([(i,)], "id long")
    by_article = {k: v.count() for k, v in retention.cascade_delete(stored, articles=keys(10)).items()}
    assert by_article == {"sources": 2, "articles": 1, **{n: 1 for n in retention.CHILDREN}}
    by_source = retention.cascade_delete(stored, sources=keys(2))
    assert by_source["articles"].first().id == 10 and by_source["bookmarks"].first().article_id == 10 and by_source["sources"].count() == 1


def test_comparison_and_cutoff(spark):
    rows = [("s", "positive", NOW - 30 * DAY, 0.1, None), ("s", "negative", NOW, 0.2, 1.0), ("s", "negative", NOW, 0.4, 2.0), (None, "neutral", NOW, 0.0, None),
            ("s", "neutral", NOW - 31 * DAY, 0.0, None)]
    log = spark.createDataFrame(rows, "source_name string, sentiment_label string, ingested_at timestamp_ntz, sentiment_score double, sentiment_magnitude double")
    got = {r.sentiment_label: r.percentage for r in analytics.source_sentiment_comparison(log, NOW).collect()}
    assert got == {"positive": 33.33, "negative": 66.67}
    trend = {(str(r.date), r.sentiment_label): (r.article_count, r.avg_magnitude) for r in analytics.sentiment_trends(log, NOW).collect()}
    assert trend == {("2025-11-20", "negative"): (2, 1.5), ("2025-11-20", "neutral"): (1, None), ("2025-10-21", "positive"): (1, None)}


def test_feed_cap_and_union(spark):
    feed = raw(spark, *[item(i, "a", url=f"https://e.com/{i}", published_at=f"2025-11-18T10:{i % 60:02d}:00Z") for i in range(40)])
    picked = feeds.select_feed(feed, "2025-11-18")
    assert picked.count() == 25 and {r.ingest_seq for r in picked.collect()} == set(range(15, 40))
    assert feeds.select_feed(feed.withColumn("category", F.lit("sports")), "2025-11-18").count() == 0
    assert feeds.union_feeds([feed, feed.drop("image")]).count() == 80
    mixed = raw(spark, item(1, "a"), item(2, "a", category="sports"), item(3, "a", category=None))
    assert {r.ingest_seq for r in feeds.select_feed(mixed, "2025-11-18", categories="-sports").collect()} == {1, 3}
    assert {r.ingest_seq for r in feeds.select_feed(mixed, "2025-11-18", categories="general").collect()} == {1}


def test_response_log(spark, tmp_path):
    lines = [
        json.dumps({"payload_seq": 1, "source_name": "a", "payload": json.dumps({"data": [{"title": "t", "url": "u"}, {"title": "t2"}]})}),
        "{broken", json.dumps({"payload_seq": 2, "source_name": "b", "payload": "{\"error\": 1}"}),
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    log = feeds.read_responses(spark, str(tmp_path))
    assert [(r.ingest_seq, r.source_name, r.title) for r in feeds.raw_feed(log).orderBy("ingest_seq").collect()] == [(1 << 32, "a", "t"), ((1 << 32) + 1, "a", "t2")]
    assert [r.source_name for r in feeds.unreadable_responses(log).collect()] == ["b"]


def test_event_log_layout(spark, tmp_path):
    analyses = spark.createDataFrame([(1, 1, "VADER", 0.5, "positive", NOW)], "id long, article_id long, provider string, score double, label string, analyzed_at timestamp_ntz")
    articles = spark.createDataFrame([(1, "u", "t", "s", NOW, None, "gb", "c")], "id long, url string, title string, source_name string, published_at timestamp_ntz, language string, country string, category string")
    built = events.build_events(analyses, articles, NOW)
    path = str(tmp_path / "log")
    assert events.append_events(built, path) and events.append_events(built.withColumn("event_id", F.lit("x")), path)
    back = events.read_events(spark, path)
    row = back.filter("event_id <> 'x'").first()
    assert row.event_id == f"1_VADER_{int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())}"
    assert (row.language, row.country, row.sentiment_model, row.extraction_method) == ("en", "gb", "vader_lexicon", "web_crawl")
    plan = analytics.recent_events(back, NOW, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingested_date" in plan
    assert not events.append_events(built, "/proc/no/such")


def test_retention_write_back(spark, tmp_path):
    """Days that expire whole leave the table, boundary days are rewritten, others keep their files; one failing part is reported."""
    texts = spark.createDataFrame([(i, f"t{i}", NOW - i * 12 * HOUR) for i in range(40)], "article_id long, text string, extracted_at timestamp_ntz")
    jobs = spark.createDataFrame(
        [(i, 1, "SUCCESS" if i % 2 else "PENDING", NOW - i * DAY) for i in range(20)], "id long, article_id long, status string, created_at timestamp_ntz"
    )
    stored, paths = {}, {}
    for name, rows in (("article_contents", content.content_store(texts)), ("crawl_jobs", jobs)):
        paths[name] = str(tmp_path / name)
        tables.create_days(rows, name, paths[name])
        stored[name] = tables.read_days(spark, name, paths[name], rows.schema)

    def sink(name):
        schema = stored[name].drop(tables.day_column(name)).schema

        def store(kept, days):
            tables.replace_days(spark, kept, days, name, paths[name])
            return tables.read_days(spark, name, paths[name], schema)

        return store

    others = {n: jobs.limit(0) for n in ("sources", "articles", "sentiment_analyses")}
    report = analytics.run_cleanup({**others, **stored}, NOW, {"article_contents": sink("article_contents"), "crawl_jobs": lambda *_: 1 / 0})
    assert "division" in report["crawl_job_cleanup_error"]
    assert report["content_cleanup"]["expired_content_deleted"] == 26 and report["content_cleanup"]["total_content_remaining"] == 14
    assert report["database_stats"]["article_contents_count"] == 14 and report["database_stats"]["crawl_jobs_count"] == 20
    left = tables.read_days(spark, "article_contents", paths["article_contents"], content.content_store(texts).schema)
    assert {r.article_id for r in left.collect()} == set(range(14))
    report = analytics.run_cleanup({**others, **stored}, NOW, {n: sink(n) for n in paths})
    assert report["crawl_job_cleanup"]["old_crawl_jobs_deleted"] == 6
    kept = tables.read_days(spark, "crawl_jobs", paths["crawl_jobs"], jobs.schema)
    assert {r.id for r in kept.collect()} == {i for i in range(20) if i % 2 == 0 or i <= 7}
    tables.create_days(jobs.limit(0), "crawl_jobs", str(tmp_path / "none"))
    assert tables.read_days(spark, "crawl_jobs", str(tmp_path / "none"), jobs.schema).count() == 0


def test_stream_ingest_batches(spark, tmp_path):
    """Three arrivals of the same story in three batches are stored once; a rerun adds nothing."""
    log = tmp_path / "log"
    log.mkdir()
    words = sentiment.default_lexicon(spark)

    def run():
        streams.drain(streams.ingest_stream(
            feeds.stream_responses(spark, str(log), 1), words, str(tmp_path / "out"), str(tmp_path / "cp"), score=sentiment.lexicon_scores_plain))
        return sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def arrive(n, *urls):
        data = [{"title": "t", "description": "d", "url": u, "published_at": "2025-11-18"} for u in urls]
        (log / f"{n}.json").write_text(json.dumps({"payload_seq": n, "source_name": "a", "payload": json.dumps({"data": data})}))

    arrive(1, "https://e.com/x?1", "https://e.com/x?2")
    assert run() == ["https://e.com/x"]
    arrive(2, "https://e.com/x?3", "https://e.com/y")
    assert run() == ["https://e.com/x", "https://e.com/y"] == run()


def test_nested_parts(spark):
    articles = spark.range(25_600).selectExpr("shiftleft(id div 100, 32) | id % 100 AS id", "1L AS source_id")  # ids as feeds pack them
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    rows = reads.sources_with_articles(dim, articles, per_row=100).collect()
    assert sorted(x for r in rows if r.source_id == 1 for x in r.article_ids) == sorted(r.id for r in articles.collect())
    assert len(rows) == 257 and max(len(r.article_ids) for r in rows) < 200 and [list(r.article_ids) for r in rows if r.source_id == 2] == [[]]


def test_stream_trend_counts_late_events(spark, tmp_path):
    """An event months late is counted on its day, as the batch trend does."""
    schema = "ingested_at timestamp_ntz, sentiment_label string, sentiment_score double, sentiment_magnitude double"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.drain(streams.trend_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")))
        return {(r.date, r.sentiment_label): (r.article_count, r.avg_sentiment_score, r.avg_magnitude) for r in streams.trend_table(spark, str(tmp_path / "out")).collect()}

    old = NOW - 90 * DAY
    run((NOW, "positive", 0.5, None))
    assert run((NOW, "positive", 1.0, 0.2), (old, "negative", -0.5, None)) == {
        (NOW.date(), "positive"): (2, 0.75, 0.2), (old.date(), "negative"): (1, -0.5, None),
    }
