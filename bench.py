"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores.
Each query runs to the end with its rows discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomseries.queries import all_queries  # noqa: E402
from loomseries.session import build_session  # noqa: E402

HEADLINES = [
    "ind_sma", "ind_bbands", "ind_wma", "ind_aroon", "ind_stoch", "ind_obv", "ind_ema", "ind_macd", "ind_tema",
    "ind_rsi", "ind_atr", "ind_adx", "ind_kama", "ind_psar", "candles_mask", "running_stats", "calls_by_step",
    "validation_summary", "message_cost", "upsert_paths", "word_counts", "rank_weighted_score", "sorted_ranks",
    "vector_top_k", "range_aggregate", "asof_last", "narrowest_interval", "graph_levels", "graph_closure", "graph_paths",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the JVM paths and the Python workers before the clock runs.
    for name in ("ind_sma", "ind_ema"):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


main()
