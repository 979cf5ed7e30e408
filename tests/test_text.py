import datetime as dt
from urllib.parse import quote, unquote, urlparse, urlunparse

from pyspark.sql import functions as F

from pressgauge.functions import text as X
from pressgauge.operators.html_text import extract_text, main_text

URLS = [
    "https://example.com/article?utm=test#fragment", "https://Ex.com:8080/a;p=1?q#f", "HTTPS://Ex.com/a/;x/b;c=2",
    "http://user:pw@Host.com/x", "//host/path?x", "https://h.com", "https://h.com?x=1", "ftp://h/a;b", "mailto:a;b@c",
    "http://host;x/y;z", " https://lead.com/a\nb", "/only/path;v=1", "https://h.com/a#b?c",
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_url_equals_urlparse(spark):
    def canonical(url):
        p = urlparse(url)
        return urlunparse((p.scheme, p.netloc, p.path, "", "", ""))

    assert column(spark, URLS, X.canonical_url) == [canonical(u) for u in URLS]


def test_domain_equals_urlparse(spark):
    assert column(spark, URLS, X.url_domain) == [urlparse(u).netloc.lower() for u in URLS]


def test_strip_equals_python(spark):
    values = ["  a b \t", " x　", "\x1c\x85y ", "", "\n\n", "plain"]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_percent_coding_equals_python(spark):
    values = ["/a b", "/a%20b+c", "/%zz%4", "/é~*_-.", "/%C3%A9%2f", "/?x=1&y=#z"]
    got = column(spark, values, lambda c: X.percent_encode(X.percent_decode(c)))
    assert got == [quote(unquote(v)) for v in values]


def test_parse_iso(spark):
    d = dt.datetime
    cases = {
        "2025-11-18T10:30:00Z": d(2025, 11, 18, 10, 30), "2025-11-18T10:30:00+02:00": d(2025, 11, 18, 8, 30),
        "20251118T103000-0530": d(2025, 11, 18, 16, 0), "2025-11-18": d(2025, 11, 18), "2025-11": d(2025, 11, 1),
        "2025": d(2025, 1, 1), "2025-11-18 10:30:00.123456": d(2025, 11, 18, 10, 30, 0, 123456),
        "2025-11-18T24:00": d(2025, 11, 19), "soon": None, "2025-13-01": None, "2025-1-1": None, "": None, None: None,
        "2025-11-18T10:30:00+02": d(2025, 11, 18, 8, 30), "2025-02-30": None,
        "2025-W47-2": d(2025, 11, 18), "2025W472T10:30Z": d(2025, 11, 18, 10, 30), "2026-W01": d(2025, 12, 29),
        "2020-W53-7": d(2021, 1, 3), "2025-W53-1": None, "2025-W00-1": None, "2025-322": d(2025, 11, 18), "2024366": d(2024, 12, 31),
        "2025-366": None, "2025-000": None,
    }
    assert column(spark, list(cases), X.parse_iso) == list(cases.values())


LONG = "word " * 30  # 149 characters once stripped


def test_main_text_rules():
    article = f"<html><body><p>out</p><article><h1>T</h1>{LONG}<script>x</script><nav>n</nav></article></body></html>"
    assert main_text(article) == "T " + LONG.strip()
    # a short article gives way to the next place that is long enough
    assert main_text(f"<body><article>{'a' * 40}</article><div class='x content'>{'b' * 150}</div></body>") == "b" * 150
    # a later shorter match overwrites, then the body steps in
    page = f"<body><div class='article-body'>{'c' * 80}</div><main>{'d' * 30}</main></body>"
    assert main_text(page) == "c" * 80 + " " + "d" * 30
    # exactly 100 characters neither end the search nor fall back
    assert main_text(f"<body><p>zz</p><article>{'e' * 100}</article></body>") == "e" * 100
    assert main_text("<p>no body</p>") is None
    assert main_text("<article>short</article>") == "short"
    assert main_text(None) is None
    assert main_text("<body> \n </body>") is None


def test_main_text_markup():
    assert main_text(f"<body><div role='article'>{LONG}</div>tail</body>") == LONG.strip()
    # unclosed and stray tags, entities, comments, void elements
    page = "<body><p>a &amp; b<br>c<!-- x -->d</div><p>e&#233;&#x41;&nbsp;</body>"
    assert main_text(page) == "a & b c d eéA"
    assert main_text("<body><header>h</header><p>x\n\n  y </p><style>p{}</style><footer>f</footer></body>") == "x\ny"
    assert main_text("<body><aside>drop <article>" + "k" * 200 + "</article></aside>rest</body>") == "rest"
    assert main_text("<body><template><p>t</p></template>seen</body>") == "seen"


def test_extract_text_keeps_every_page(spark):
    pages = spark.createDataFrame([(i, f"<body>page {i}</body>") for i in range(50)], "page_id long, html string")
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == {i: f"page {i}" for i in range(50)}
