"""Robots rules against the standard library, the gate against a plain scan, the status chain."""

import datetime as dt
import random
from urllib.robotparser import RobotFileParser

import pandas as pd
import pytest

from pressgauge.operators import crawl, crawl_stored, html_text, ingest, politeness, robots, sentiment
from pressgauge.sources import events
from pressgauge.streaming import streams

AGENT = "newsbot/1.0 (+https://example.org)"
NOON = dt.datetime(2025, 11, 20, 12)


def random_body(rng):
    lines = []
    for _ in range(rng.randint(0, 14)):
        lines.append(rng.choice([
            "User-agent: *", "User-agent: NewsBot", "user-agent : otherbot", "", "# note", "Disallow:", "Allow: /",
            f"Disallow: /{rng.choice('abc')}", f"Allow: /{rng.choice('abc')}/{rng.choice('de')}", "Disallow: /a%20b # x",
            f"Crawl-delay: {rng.choice(['0', '2', '0.5', '7'])}", "Request-rate: 1/5", "Sitemap: https://x/y", "nonsense", "Disallow: *",
            "Disallow: /b?x=1",
        ]))
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_robots_equal_stdlib(spark):
    rng = random.Random(3)
    bodies = {f"h{i}.org": random_body(rng) for i in range(300)}
    paths = ["", "/", "/a", "/a/d/x", "/b/e", "/c?q=1", "/a b", "/a%20b/c", "/b?x=1&y", "/abc#f"]
    files = spark.createDataFrame([(d, 200, b, NOON) for d, b in bodies.items()], "domain string, http_status int, body string, fetched_at timestamp_ntz")
    urls = [f"https://{d}{p}" for d in bodies for p in paths]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.allowed, r.crawl_delay) for r in robots.robots_check(df, files, AGENT).collect()}
    looked_up = robots.robots_check(df, files, AGENT, rules_in_row=2)
    assert {r.url: (r.allowed, r.crawl_delay) for r in looked_up.collect()} == got
    for domain, body in bodies.items():
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        delay = parser.crawl_delay(AGENT)
        for p in paths:
            url = f"https://{domain}{p}"
            assert got[url] == (parser.can_fetch(AGENT, url), float(delay) if delay else None), (body, url)


def test_robots_with_many_rules(spark):
    """100,000 rules of one domain: the first by position decides, urls repeat, and no url scans the rules."""
    rng = random.Random(8)
    rules = [("Allow" if rng.random() < 0.5 else "Disallow", f"/{rng.randrange(30)}/{rng.randrange(40)}/{rng.randrange(2000)}") for _ in range(100_000)]
    rules.insert(50_000, ("Disallow", "/7/"))
    body = "User-agent: *\n" + "\n".join(f"{kind}: {path}" for kind, path in rules)
    files = spark.createDataFrame(
        [("big.org", 200, body, NOON), ("small.org", 200, "User-agent: *\nDisallow: /7/", NOON)],
        "domain string, http_status int, body string, fetched_at timestamp_ntz",
    )
    paths = [f"/{rng.randrange(30)}/{rng.randrange(40)}/{rng.randrange(3000)}" for _ in range(4000)] + ["/7/x"] * 500 + ["", "/7"]
    urls = [(i, f"https://{rng.choice(['big', 'big', 'small', 'none'])}.org{p}") for i, p in enumerate(paths)] + [(-1, None)]
    got = {r.n: r.allowed for r in robots.robots_check(spark.createDataFrame(urls, "n int, url string"), files, AGENT).collect()}
    first = {}
    for pos, (kind, path) in enumerate(rules):
        first.setdefault(path, (pos, kind == "Allow"))
    for n, url in urls:
        host, _, path = (url or "").removeprefix("https://").partition("/")
        target = "/" + path
        if host == "big.org":
            found = min((first[target[:k]] for k in range(1, len(target) + 1) if target[:k] in first), default=(0, True))
            assert got[n] == found[1], url
        else:
            assert got[n] == (host != "small.org" or not target.startswith("/7/")), url
    assert len(got) == len(urls)


def test_robots_missing_and_failed(spark):
    files = spark.createDataFrame([("a.org", 404, None, NOON)], "domain string, http_status int, body string, fetched_at timestamp_ntz")
    urls = spark.createDataFrame([("https://a.org/x",), ("https://b.org/x",)], "url string")
    rows = {r.domain: (r.allowed, r.reason) for r in robots.robots_check(urls, files, AGENT).collect()}
    assert rows["a.org"] == (True, "Allowed by robots.txt")
    assert rows["b.org"] == (True, "No robots.txt or fetch failed (permissive default)")
    strict = {r.domain: r.allowed for r in robots.robots_check(urls, files, AGENT, on_missing="deny").collect()}
    assert strict == {"a.org": False, "b.org": True}


def test_snapshot_freshness(spark):
    hour = dt.timedelta(hours=1)
    rows = [("a", 200, "x", NOON - 24 * hour), ("b", 200, "x", NOON - 23 * hour), ("b", 500, None, NOON - hour), ("c", 500, None, NOON)]
    files = spark.createDataFrame(rows, "domain string, http_status int, body string, fetched_at timestamp_ntz")
    got = {r.domain: r.fresh for r in robots.robots_snapshot(files, NOON).collect()}
    assert got == {"a": False, "b": True}
    urls = spark.createDataFrame([(f"https://{d}/",) for d in "abc"], "url string")
    assert {r.domain for r in robots.refetch_list(files, urls, NOON).collect()} == {"a", "c"}


def scan(requests):
    """requests: (domain, job_id, seconds, delay, fetched) in any order."""
    last, out = {}, {}
    for domain, job, t, delay, fetched in sorted(requests, key=lambda r: (r[2], r[1])):
        allowed = domain not in last or round(t * 1e6) >= last[domain] + round((delay or 1.0) * 1e6)
        out[job] = allowed
        if allowed and fetched:
            last[domain] = round(t * 1e6)
    return out


def frame(spark, requests):
    start = dt.datetime(2025, 1, 1)
    rows = [(d, j, start + dt.timedelta(microseconds=round(t * 1e6)), delay, f) for d, j, t, delay, f in requests]
    return spark.createDataFrame(rows, "domain string, job_id long, requested_at timestamp_ntz, delay double, fetched boolean")


def test_gate_example(spark):
    requests = [("d", i, t, 1.0, True) for i, t in enumerate([0.0, 0.6, 1.0, 1.5, 2.0])]
    got = {r.job_id: r.polite for r in politeness.politeness_gate(frame(spark, requests)).collect()}
    assert [got[i] for i in range(5)] == [True, False, True, False, True]


@pytest.mark.parametrize("slice_delays", [1, 3, 4096])
def test_gate_equals_scan(spark, slice_delays):
    """One domain holds most requests, over many slices; ties, failures and default delays included."""
    rng = random.Random(slice_delays)
    delays = {"hot": 2.0, "none": None, "zero": 0.0, "slow": 30.0}
    requests = []
    for job in range(6000):
        domain = rng.choices(list(delays), [6, 1, 1, 1])[0]
        requests.append((domain, job + (1 << 60), round(rng.random() * 900, 1), delays[domain], rng.random() < 0.7))
    got = {r.job_id: r.polite for r in politeness.politeness_gate(frame(spark, requests), slice_delays).collect()}
    assert got == scan(requests)


def test_gate_stream_over_batches(spark, tmp_path):
    """State carries the clock from one file to the next."""
    rng = random.Random(5)
    requests = sorted(
        [(rng.choice("abc"), i, round(rng.random() * 300, 2), 3.0, rng.random() < 0.8) for i in range(600)], key=lambda r: (r[2], r[1])
    )
    for part in range(3):
        frame(spark, requests[part * 200 : (part + 1) * 200]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, requests[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.drain(streams.politeness_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.job_id: r.polite for r in streams.politeness_verdicts(spark, str(tmp_path / "out")).collect()}
    assert got == scan(requests)


def test_status_chain(spark):
    schema = (
        "id long, article_id long, created_at timestamp_ntz, robots_allowed boolean, robots_reason string, polite boolean, "
        "response_status int, response_error string, bytes long, fetched_at timestamp_ntz, has_text boolean, processing_error string"
    )
    ok = (NOON, True, "r", True, 200, None, 10, NOON, True, None)
    rows = [
        (1, 1, NOON, False, "denied", False, None, None, None, NOON, False, None),
        (2, 2, NOON, True, "r", False, 200, None, 10, NOON, True, None),
        (3, 3, NOON, True, "r", True, 503, None, 10, NOON, False, None),
        (4, 4, NOON, True, "r", True, None, "timeout", None, NOON, False, None),
        (5, 5, NOON, True, "r", True, 200, None, 10, NOON, False, None),
        (6, 6, NOON, True, "r", True, 200, None, 10, NOON, True, "boom"),
        (7, 7, *ok),
    ]
    got = {r.id: r for r in crawl.crawl_outcomes(spark.createDataFrame(rows, schema), NOON).collect()}
    assert [got[i].status for i in range(1, 8)] == ["FORBIDDEN_BY_ROBOTS", "RATE_LIMITED", "FAILED", "FAILED", "FAILED", "FAILED", "SUCCESS"]
    assert [got[i].error_code for i in range(1, 8)] == [None, None, "NETWORK_ERROR", "NETWORK_ERROR", None, "PROCESSING_ERROR", None]
    assert got[1].error_message == "denied" and got[2].error_message == "Rate limited - respecting crawl delay"
    assert got[3].http_status is None and got[4].error_message == "Network error: timeout"
    assert got[5].error_message == "No article content could be extracted" and got[5].http_status == 200
    assert got[6].error_message == "Processing error: boom" and got[7].error_message is None and got[7].bytes_downloaded == 10


def test_gate_stream_decides_a_batch_in_order(spark, tmp_path):
    """One domain with 50,000 shuffled requests in one micro-batch equals the scan."""
    rng = random.Random(9)
    requests = [("d", i, round(rng.random() * 9000, 2), 1.5, rng.random() < 0.8) for i in range(50_000)]
    rng.shuffle(requests)
    frame(spark, requests).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, requests[:1]).schema).parquet(str(tmp_path / "in"))
    streams.drain(streams.politeness_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 64))
    assert {r.job_id: r.polite for r in streams.politeness_verdicts(spark, str(tmp_path / "out")).collect()} == scan(requests)


def test_html_reader_is_linear_and_reports_errors(monkeypatch):
    import time

    def seconds(n):
        page = "<body>" + "<p>one<li><b>two</b>" * n
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    seconds(2000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.5

    def fail(self, data):
        raise ValueError("odd page")

    monkeypatch.setattr(html_text._Reader, "feed", fail)
    assert html_text.read_page("<p>") == (None, "ValueError: odd page")


def test_crawl_run_on_stored_jobs_and_repeated_fetches(spark):
    """Stored job ids equal article ids, an article has two jobs, a url was fetched twice: one outcome a job, one text an article."""
    late = NOON + dt.timedelta(hours=1)
    page = "<html><body><article>" + "good words " * 20 + "</article></body></html>"
    articles = spark.createDataFrame(
        [(i, i, f"t{i}", f"https://h{i}.org/a", NOON, None, None, "en", None, None, "s") for i in (1, 2, 3)],
        "id long, source_id long, title string, url string, published_at timestamp_ntz, sentiment_label string, sentiment_score double, "
        "language string, country string, category string, source_name string",
    )
    old = spark.createDataFrame(
        [(1, 1, "PENDING", NOON), (3, 2, "PENDING", NOON), (7, 1, "SUCCESS", NOON)], "id long, article_id long, status string, created_at timestamp_ntz"
    )
    new = ingest.create_crawl_jobs(articles, old, NOON)
    jobs = new.limit(0).unionByName(old, allowMissingColumns=True)
    fetches = spark.createDataFrame(
        [(f"https://h{i}.org/a", t, code, None, html) for i in (1, 2, 3) for t, code, html in ((NOON, 503, None), (late, 200, page))],
        "url string, requested_at timestamp_ntz, response_status int, response_error string, html string",
    )
    files = spark.createDataFrame([], "domain string, http_status int, body string, fetched_at timestamp_ntz")
    contents = spark.createDataFrame(
        [], "id long, article_id long, content_text string, content_hash string, content_length int, extracted_at timestamp_ntz, expires_at timestamp_ntz"
    )
    model = spark.createDataFrame([(1, -0.9, 0.4)], "article_id long, score double, magnitude double")
    tables = {"articles": articles, "crawl_jobs": jobs, "article_contents": contents}
    run = crawl.crawl_run(tables, fetches, files, sentiment.default_lexicon(spark), late, None, None, provider="GCP_NL", model_scores=model)
    outcomes = run["outcomes"].collect()
    assert len(outcomes) == len({r.id for r in outcomes}) == 3 and {r.status for r in outcomes} == {"SUCCESS"}
    assert {r.article_id for r in run["contents"].collect()} == {1, 2, 3} and run["contents"].count() == 3
    made = {r.article_id: (r.provider, r.magnitude, r.label, r.model_name) for r in run["analyses"].collect()}
    assert made[1] == ("GCP_NL", 0.4, "negative", "gcp_nl_v1") and made[2] == ("VADER", None, "positive", "vader_lexicon")
    assert run["events"].count() == 3


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<!-- >", "<![CDATA[ >", "</a ", "<?x ", "<a b='"])
def test_unclosed_tags_take_linear_time(piece):
    import time

    def seconds(n):
        page = "<body>" + piece * n
        start = time.process_time()
        html_text.read_page(page)
        return time.process_time() - start

    small = min(seconds(40_000) for _ in range(3))
    assert min(seconds(160_000) for _ in range(3)) < 10 * small + 0.05


def test_unfinished_tails():
    long = "word " * 30
    assert html_text.main_text(f"<body><p>{long}</p><a ") == long.strip() + " <a"
    assert html_text.main_text(f"<article>{long}</article>" + "<a " * 300) == long.strip()
    assert html_text.main_text("<body>some text" + "<a " * 101) == "some text" + ("<a " * 101).rstrip()
    assert html_text.main_text("<body>some text<script>" + "<a " * 101) == "some text"


def test_stored_run_breaks_off_and_goes_on(spark, tmp_path, monkeypatch):
    """A run dies before its second and before its last commit; called again it leaves what an undisturbed run leaves, and so does a replay."""
    page = "<html><body><article>" + "good words " * 20 + "</article></body></html>"
    article = [(i, i % 2, f"t{i}", f"https://h{i}.org/a", NOON, "en") for i in range(1, 6)]
    articles = spark.createDataFrame(article, "id long, source_id long, title string, url string, published_at timestamp_ntz, language string")
    for c, kind in [("description", "string"), ("image_url", "string"), ("country", "string"), ("category", "string"), ("sentiment_label", "string"), ("sentiment_score", "double")]:
        articles = articles.selectExpr("*", f"CAST(NULL AS {kind}) AS {c}")
    sources = spark.createDataFrame([(0, "even"), (1, "odd")], "id long, name string")
    early = NOON - dt.timedelta(days=2)
    old = spark.createDataFrame(
        [(1, 1, "PENDING", early, early), (2, 2, "IN_PROGRESS", early, early), (3, 3, "SUCCESS", early, early), (4, 99, "PENDING", early, early)],
        "id long, article_id long, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    jobs = ingest.create_crawl_jobs(articles, old, NOON).limit(0).unionByName(old, allowMissingColumns=True)
    fetches = spark.createDataFrame(
        [(f"https://h{i}.org/a", NOON, 503 if i == 5 else 200, None, page) for i in range(1, 6)],
        "url string, requested_at timestamp_ntz, response_status int, response_error string, html string",
    )
    files = spark.createDataFrame([], "domain string, http_status int, body string, fetched_at timestamp_ntz")
    lexicon = sentiment.default_lexicon(spark)
    real = crawl_stored.Versions.commit

    def run(stores, root):
        return crawl_stored.stored_crawl_run(
            stores, sources, f"{root}/events", fetches, files, lexicon, NOON, None, None, abandoned_hours=24
        )

    def result(stores, root):
        out = {n: sorted(map(str, crawl_stored.stored(s).collect())) for n, s in stores.items()}
        return {**out, "events": sorted(map(str, events.read_events(spark, f"{root}/events").collect()))}

    wanted = None
    for broken in (None, 1, 5):
        root = str(tmp_path / f"run{broken}")
        stores = crawl_stored.open_tables(spark, root, 2)
        stores["articles"].append(articles)
        stores["crawl_jobs"].append(jobs)
        done = []

        def commit(self, *args, **more):
            if broken is not None and len(done) == broken:
                done.append("broken")
                raise OSError("lost")
            done.append(self.path)
            return real(self, *args, **more)

        with monkeypatch.context() as m:
            m.setattr(crawl_stored.Versions, "commit", commit)
            if broken is not None:
                # the event log's failure is reported, not raised
                with pytest.raises(OSError):
                    run(stores, root)
            counts = run(stores, root)
        assert counts == {"processed": 4, "successful": 3, "failed": 1, "new_jobs_created": 2}
        got = result(stores, root)
        if wanted is None:
            wanted = got
            state = {r.id: r.status for r in crawl_stored.stored(stores["crawl_jobs"]).collect()}
            assert [state[i] for i in (1, 2, 3, 4)] == ["SUCCESS", "SUCCESS", "SUCCESS", "PENDING"]
            assert len(got["events"]) == len(got["sentiment_analyses"]) == len(got["article_contents"]) == 3
            versions = {n: s.snapshot().version for n, s in stores.items()}
            assert run(stores, root) == counts and {n: s.snapshot().version for n, s in stores.items()} == versions
        assert got == wanted, broken


def test_slices_of_a_batch_go_together(monkeypatch):
    """A thousand short slices in one batch: only those at its ends are followed alone, and exits equal a walk by hand."""
    rng, calls = random.Random(4), []
    real = politeness._advance
    monkeypatch.setattr(politeness, "_advance", lambda *args: calls.append(1) or real(*args))
    rows = sorted((domain, t // (d * 4), t, d, rng.random() < 0.7) for domain, d in (("a", 3), ("b", 5)) for t in (rng.randrange(1, 9000) for _ in range(1500)))
    batch = pd.DataFrame(rows, columns=["domain", "slice", "t", "d", "moves"])
    got = pd.concat(politeness._slice_exits(4)(iter([batch])))
    assert len(calls) <= 2
    want = set()
    for (domain, part, d), group in batch.groupby(["domain", "slice", "d"]):
        times = sorted(set(group["t"][group["moves"]]))
        early = sum(t < part * d * 4 + d for t in times)
        for first in times[: early + 1]:
            last = first
            while later := [t for t in times if t >= last + d]:
                last = later[0]
            want.add((domain, part, d, first, last))
        if not times:
            want.add((domain, part, d, politeness.NO_FETCH, politeness.NO_FETCH))
    assert len(got) == len(want) > 500 and {tuple(r) for r in got.itertuples(index=False)} == want
