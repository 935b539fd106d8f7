"""Queries beside their SQL on ticks of which some have a price of zero."""

import os

import pytest

from oracle import check, connect
from tidemark.operators import rollups
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

SOURCE = "/root/testdata/sf0.001"
NAMES = """
opening_range_grid opening_grid_neighbours
asof_quote_per_fill
cost_model_lookup
decision_ranking
drift_states
excursions_fixed_horizon
excursions_to_session_end
isolated_bad_ticks
keep_set_mask
order_flow_imbalance
post_stop_rally
time_weighted_imbalance
run_up_features
slippage_quantiles
""".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import duckdb

    out = tmp_path_factory.mktemp("zero")
    for name in os.listdir(SOURCE):
        if name != "events.parquet":
            os.symlink(f"{SOURCE}/{name}", out / name)
    # Ten copies, stamps moved within the day; a price in 23 is zero.
    duckdb.sql(f"""COPY (SELECT event_id + k * 1000000 AS event_id, ts + to_seconds(k * 7919) AS ts, user_id, event_type,
        CASE WHEN (event_id * 7 + k) % 23 = 0 THEN 0.0 ELSE value END AS value, props FROM range(10) r(k), '{SOURCE}/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)""")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_zero_prices(spark, folder, name):
    _, rows, why, without_sql = check(spark, connect(folder), folder, name, QUERIES[name], ORACLE_SQL.get(name))
    assert rows and not why and not without_sql


def test_a_total_of_zero_is_not_profitable(spark):
    trades = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", -0.3), ("b", 0.5)], "symbol string, net double")
    row = rollups.share_profitable(trades.coalesce(1)).first()
    assert (row.profitable, row.symbols) == (1, 2)
