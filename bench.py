"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is read on local[BENCH_CPUS]; every
query writes all of its rows to a no-op sink.  A query's time is the median of
BENCH_RUNS runs (default 1) after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from touchline.plans.catalog import QUERIES
from touchline.session import local_session

HEADLINE = (
    "league_table", "team_features", "clean_matches", "match_features_full", "correlation_pairs", "outcome_distribution",
    "goals_histogram", "kpi_summary", "scatter_points", "streak_continuation", "team_comparison", "score_fixtures",
    "score_requests", "classification_report", "message_answers", "split_counts_stratified", "roundtrip_features",
)


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: tuple[str, ...]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(tuple(sys.argv[1:]) or HEADLINE)
