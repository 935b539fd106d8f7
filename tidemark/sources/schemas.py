"""Table schemas of the store: columns as DDL, with the key and the partition column of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

OHLCV = "open double, high double, low double, close double, volume bigint"


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    key: tuple[str, ...]
    partition: str | None = None

    @property
    def replaces(self) -> tuple[str, ...]:
        """What one load replaces: its run where rows belong to runs, otherwise the rows of its keys."""
        return ("run_id",) if "run_id" in self.key else self.key

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


# The store's tables, columns and keys.
TABLES = {
    t.name: t
    for t in (
        Table("bar_daily", f"dataset string, symbol string, session_date date, {OHLCV}, dollar_volume double", ("dataset", "symbol", "session_date"), "dataset"),
        Table("bar_minute", f"dataset string, symbol string, ts_utc timestamp, {OHLCV}, session_date date", ("dataset", "symbol", "ts_utc"), "session_date"),
        Table("day_dollar_volume", "symbol string, session_date date, close double, volume bigint, dollar_volume double", ("symbol", "session_date"), "session_date"),
        Table("screen_run", "run_id string, run_at timestamp, dataset string, archive string, min_rvol double, min_range_pct double, min_avg_dollar_vol double, max_per_day int, price_min double, price_max double, reject_seed int, n_candidates int, n_rejects int", ("run_id",), "run_id"),
        Table("screen_candidate", "run_id string, symbol string, session_date date, is_reject boolean", ("run_id", "symbol", "session_date"), "run_id"),
        Table("flex_execution", "trade_id string, symbol string, trade_date date, dt_utc timestamp, et_minute int, qty double, price double, commission double, fifo_pnl double, side string, time_known boolean", ("trade_id",), "trade_date"),
        Table("flex_round_trip", "symbol string, trade_date date, seq int, entry_et string, exit_et string, fills int, shares double, max_position int, avg_buy_price double, avg_sell_price double, gross_pnl double, commission double, net_pnl double, open_at_end boolean", ("symbol", "trade_date", "seq"), "trade_date"),
        Table("backtest_run", "run_id string, run_at timestamp, strategy string, universe string, pairs string, cache_dir string, size_from string, offline boolean, exit_mode string, n_trades int, n_pairs int", ("run_id",), "run_id"),
        Table("backtest_trade", "run_id string, seq int, symbol string, session_date date, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, qty int, reason string, bars_held int, gross double, commission double, net double, cycles int, shares_traded int, adds int, max_qty int, timeframe int, setup_kind string, trade_exit_mode string, r_multiple double, session_block string", ("run_id", "seq"), "run_id"),
        Table("backtest_coverage", "run_id string, symbol string, session_date date, status string, bars int, session_bars int, trades int, net double", ("run_id", "symbol", "session_date"), "run_id"),
        Table("compound_run", "run_id string, source string, run_at timestamp, capital double, per_trade_pct double, total_pct double, dv_cap_pct double, dv_applied boolean, taken int, skipped_concurrency int, skipped_ruined int, skipped_too_small int, dv_capped int, final double, multiple double, max_drawdown double", ("run_id", "source"), "run_id"),
        Table("compound_sweep", "run_id string, source string, per_trade_pct double, total_pct double, final double, multiple double, max_drawdown double, taken int, skipped int, dv_capped int", ("run_id", "source", "per_trade_pct", "total_pct"), "run_id"),
        Table("orb_preflight", "dataset string, symbol string, session_date date, orb_minutes int, population string, status string, range_bars int, rth_bars int, orb_high double, orb_low double, width_pct double, orb_volume double, price_at_range_end double, change_from_open_pct double, in_price_band boolean, passes_rth_move boolean, up_trigger boolean, down_trigger boolean, up_trigger_bar int, up_close_over_pct double, near_level boolean, retest_touch boolean, retest_zone boolean, entry_px double, r_structure_pct double, r_opposite_pct double, r_rangefrac_pct double, bars_to_2r int, bars_to_stop int", ("dataset", "symbol", "session_date", "orb_minutes"), "session_date"),
        Table("leak_control", "run_id string, strategy string, population string, run_at timestamp, days int, trades int, days_with_a_trade int, net double, entries_per_day double, share_of_days_traded double, net_per_day double, net_per_trade double", ("run_id", "strategy", "population"), "run_id"),
        Table("holdout_cut", "universe_fingerprint string, cut_at timestamp, lock_from date, both_halves_split date, train_first date, train_last date, lock_fraction double, n_sessions int, n_train int, n_locked int, n_early int, n_late int, note string", ("universe_fingerprint",), None),
        Table("paper_fill", "session_date date, ts_et timestamp, strategy string, symbol string, action string, status string, reason string, apex boolean, ref_close double, ref_kind string, bid double, ask double, spread double, spread_pct double, limit_sent double, qty int, fill_price double, filled_qty int, slippage_vs_ref double, seconds_to_fill double, entry_price double, exit_price double, trade_pnl double, trade_pct double, hold_minutes double, reject_reason string, macd double, macd_sig double, mfi double, rsi double, vol double, prev_vol double, trail_avg double, trail_pct double, ref_drift_pct double, exec_id string, source_file string, loaded_at timestamp", ("session_date", "ts_et", "strategy", "symbol", "action", "status"), "session_date"),
        Table("load_run", "run_id string, kind string, source_path string, source_mtime timestamp, loaded_at timestamp, rows int, notes string", ("run_id",), None),
    )
}

EXECUTION_REPORT = "TradeID string, Symbol string, TradeDate string, DateTime string, Quantity double, TradePrice double, IBCommission double, FifoPnlRealized double, `Buy/Sell` string, LevelOfDetail string, AssetClass string"
