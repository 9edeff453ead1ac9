"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default: all)
the local cores, BENCH_QUERIES (comma-separated) other queries than the headline ones.
Each query runs to its last row; the figure is the better of two runs, since the first one
also compiles its code and starts Python workers.
"""

import json
import os
import time

from feedskein.session import build_session
from feedskein.plans.catalogue import QUERIES

HEADLINE = [
    "feed_list_unread", "articles_all", "articles_by_feed", "article_rows", "detail_meta",
    "ingest_dedup", "ingest_new_only", "ingest_rejects", "state_fold",
    "feeds_added", "feeds_lookup", "feeds_removed_cascade",
    "parse_entries", "parse_dates", "parse_rejects",
    "refresh_articles", "refresh_summary", "refresh_stream",
    "page_links", "page_text", "discover_fallback", "subscriptions",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
