"""Headline queries, timed end to end; prints one JSON line.

Each query is computed in full into Spark's no-op sink after one warm-up run of a small query.
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated, or 'all') set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "first_seen_universe", "running_screen", "bars_from_ticks", "screen_features", "bollinger_bands", "macd_lines", "asof_quote_per_fill", "asof_without_tolerance", "trailing_window_sums",
    "time_weighted_imbalance", "fill_positions", "markout_identity", "point_in_time_facts", "first_touch_exit", "trailing_stop_exit", "excursions_to_session_end", "exit_grid", "session_give_back",
    "equity_and_drawdown", "cluster_bootstrap_symbol_day", "random_removal", "rank_auc", "gate_verdict", "trend_line_breaks", "value_area", "held_series", "tranche_book", "spread_distribution",
    "stream_closed_bars", "stream_freshness_gate",
]


def main() -> None:
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["session_vwap"](spark, folder).write.format("noop").mode("overwrite").save()
    took, failed = {}, []
    for name in names:
        start = time.time()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the other times
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            failed.append(name)
            continue
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "failed": failed, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()
    os._exit(0)


if __name__ == "__main__":
    main()
