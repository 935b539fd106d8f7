"""Registered queries beside their SQL. A spread of them runs by default; TIDEMARK_ALL=1 runs all."""

import os

import pytest

from oracle import check, connect
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
SPREAD = """bars_from_ticks trade_ledger screen_features bollinger_bands rsi running_screen first_seen_universe asof_quote_per_fill asof_at_horizons markout_identity time_weighted_imbalance
halt_intervals momentum_entry_1m one_time_framing forward_run_labels first_touch_exit trailing_stop_exit session_give_back equity_and_drawdown cluster_bootstrap_symbol gate_verdict
quantile_buckets exit_grid held_series value_area stream_closed_bars stream_freshness_gate headline_labels trading_calendar study_session_rules concurrency_cap_replay match_preceding_alert match_nearest_pairs compounding_account entry_tape_features
executions_by_id json_facts store_load roll_legs missing_sessions squeeze_states content_hash stream_round_trips stream_arrivals year_table table_counts stream_signal_after_exit forward_sessions crc_subset trend_line_breaks opening_range_grid""".split()
# Queries whose rule fits no SQL text, tested by other means.
WITHOUT_SQL = """archive_inventory compounding_account entry_momentum_features extreme_anchor_lines fitted_classifiers pullback_break_setups vwap_reclaim_setups""".split()
# Queries that may find nothing in the smallest tables.
EMPTY: list[str] = []
NAMES = sorted(QUERIES) if os.environ.get("TIDEMARK_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    _, rows, why, _ = check(spark, con, FOLDER, name, QUERIES[name], ORACLE_SQL.get(name))
    assert why == ""
    assert rows > 0 or name in EMPTY


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLE_SQL) == set(WITHOUT_SQL)
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["session_date", "symbol", "first_seen", "first_rank", "best_rank", "ticks_on"]
    assert set(e.oracle_sql()) <= set(e.queries())
