"""Defaults of the operators. Fixed values the results depend on."""

# Feed selection
FEED_LANGUAGES = ["en"]
FEED_CATEGORIES = "general,business,health,science,technology,-sports,-entertainment"
FEED_LIMIT = 25

# The configured feed sources, in fetch order.
FEED_SOURCES = [
    "dw", "bbc", "cnn", "bloomberg", "politico", "independent", "time", "nytimes", "guardian", "skynews",
    "foreignpolicy", "businesstoday", "financialpost", "iotbusinessnews", "yahoo", "cnbc", "google-news",
    "scidev", "scitechdaily", "phys", "scienceandtechnologyresearchnews", "popsci",
]

# Content store
CONTENT_TTL_HOURS = 168
CONTENT_MAX_CHARS = 1024

# Retention
JOB_RETENTION_DAYS = 7
TERMINAL_STATUSES = ["SUCCESS", "FAILED", "FORBIDDEN_BY_ROBOTS"]

# Crawling
USER_AGENT = "pressgauge/1.0"
DEFAULT_CRAWL_DELAY = 1.0
ROBOTS_MAX_AGE_HOURS = 24
ROBOTS_RULES_IN_ROW = 256  # files with more rules are looked up by prefix
# Messages of the crawl.
MESSAGES = {
    "denied": "Disallowed by robots.txt for user-agent '{agent}'",
    "allowed": "Allowed by robots.txt",
    "permissive": "No robots.txt or fetch failed (permissive default)",
    "limited": "Rate limited - respecting crawl delay",
    "network": "Network error: ",
    "processing": "Processing error: ",
    "empty": "No article content could be extracted",
}
NEW_JOBS_PER_RUN = 20
JOBS_PER_RUN = 5

# Sentiment providers: (provider, positive from, negative up to, default model), bounds inclusive.
LEXICON_PROVIDER = "VADER"
MODEL_PROVIDER = "GCP_NL"
PROVIDERS = [
    ("VADER", 0.05, -0.05, "vader_lexicon"),
    ("GCP_NL", 0.25, -0.25, "gcp_nl_v1"),
]
FALLBACK_ENABLED = True
DEFAULT_LANGUAGE = "en"
SUPPORTED_LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "ru", "ja", "ko", "zh", "ar", "hi"]
MODEL_MAX_TEXT_BYTES = 1_000_000

# Analytics
TREND_DAYS = 30
