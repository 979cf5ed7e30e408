"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressgauge.plans.queries import QUERIES  # noqa: E402
from pressgauge.session import build_session  # noqa: E402

HEADLINE = [
    "sentiment_trends", "source_sentiment_comparison", "normalize_articles", "ingest_new_articles",
    "lexicon_sentiment", "extract_text", "robots_check", "politeness_gate", "content_store", "content_upsert",
    "latest_with_analyses", "latest_sentiment", "cascade_delete", "cleanup_report", "crawl_outcomes",
    "crawl_run", "sources_with_articles", "sentiment_with_fallback", "stream_events_sink", "stream_politeness_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, best of two, summed", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
