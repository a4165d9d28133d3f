"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores,
BENCH_QUERIES an optional comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from newsignal.plans import catalog
from newsignal.session import get_session

HEADLINE = [
    "label_articles", "label_crosstab", "rolling_thresholds", "closing_price", "next_close", "article_features",
    "clean_documents", "clean_pages", "narrative", "training_text", "body_rules", "lexicon_sentiment",
    "extracted_prices", "trade_decisions", "recompute_trades", "settle_predictions", "trading_metrics",
    "tracker_summary", "risk_ratios", "rolling_accuracy", "quality_report", "live_signals", "history_signals",
    "ensemble_scores", "tfidf_vocabulary", "chi2_terms", "similar_articles", "replace_upsert", "insert_if_absent",
    "repair_prices", "stream_ingest", "stream_daily_counts", "logistic_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["symbol_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()  # a failing query fails the bench
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
