"""Readers, the store and incremental scoring."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources.schemas import TABLES
from tidemark.sources.store import Store, report_refusals, write_report
from tidemark.streaming import forward


def test_executions_keep_equal_children_and_drop_repeats(spark, tmp_path):
    head = "TradeID,Symbol,TradeDate,DateTime,Quantity,TradePrice,IBCommission,FifoPnlRealized,Buy/Sell,LevelOfDetail,AssetClass\n"
    a = head + "1,BRK B,20240102,20240102;093000,10,5.0,-1,0,BUY,EXECUTION,STK\n2,BRK B,20240102,20240102;093000,10,5.0,-1,0,BUY,EXECUTION,STK\n9,X,20240102,20240102;093000,10,5.0,-1,0,BUY,ORDER,STK\n"
    b = head + "2,BRK B,20240102,20240102;093000,10,5.0,-1,0,BUY,EXECUTION,STK\n3,ES,20240102,20240102;093000,1,5.0,-1,0,SELL,EXECUTION,FUT\n"
    for n, t in (("a.csv", a), ("b.csv", b)):
        (tmp_path / n).write_text(t)
    rows = R.executions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("trade_id").collect()
    assert [(r["trade_id"], r["symbol"], r["time_known"]) for r in rows] == [("1", "BRK.B", True), ("2", "BRK.B", True)]


def test_pairs_and_nested_json(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps([{"symbol": "abc", "date": "2024-01-02"}, {"symbol": "ABC", "date": "2024-01-02"}, {"symbol": "TOOLONG", "date": "2024-01-02"}]))
    assert R.pairs(spark, [str(p)]).count() == 1
    body = json.dumps({"cik": 7, "taxonomy": "dei", "tag": "Shares", "units": {"shares": [{"end": "2023-12-31", "filed": "2024-02-01", "form": "10-K", "val": 5.0}, {"end": "2023-12-31", "filed": "2024-03-01", "form": "10-K/A", "val": 6.0}]}})
    facts = R.concept_facts(spark.createDataFrame([(body,)], "body string")).collect()
    assert sorted((str(r["filed"]), r["val"]) for r in facts) == [("2024-02-01", 5.0), ("2024-03-01", 6.0)]
    member = json.dumps({"0": {"Code": "A", "StartDate": "2020-01-01", "EndDate": "2021-01-01", "IsActiveNow": 0}, "1": {"Code": "B", "StartDate": "2020-01-01", "IsActiveNow": 1}})
    spells = R.constituents(spark.createDataFrame([(member,)], "body string"), "I").orderBy("code").collect()
    assert [r["active"] for r in spells] == [False, True]


def test_unresolved_symbols_fail_the_read(spark, tmp_path):
    spark.createDataFrame([("A", 1.0), (None, 2.0)], "symbol string, px double").write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="unresolved symbol"):
        R.bars(spark, str(tmp_path / "b")).collect()


def test_headlines_and_filings(spark, tmp_path):
    (tmp_path / "h.csv").write_text('symbol,headline,created_at,symbol_count\nA,Acme prices $5M registered direct offering,2024-01-02T10:00:00Z,1\nB,regained compliance and reverse split,2024-01-02T10:00:00Z,2\n')
    assert [r["label"] for r in R.headlines(spark, str(tmp_path / "h.csv")).orderBy("symbol").collect()] == ["OFFERING_PRICED", None]
    (tmp_path / "f.csv").write_text('symbol,form,items,accepted\nA,8-K,"1.01,5.03",2024-07-02T16:00:00.000Z\n')
    f = R.filings(spark, str(tmp_path / "f.csv")).collect()[0]
    assert f["labels"] == ["TRIGGER_A", "TRIGGER_B"] and str(f["accepted"]) == "2024-07-02 20:00:00"


def test_store_is_idempotent_and_reports_drift(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    t = spark.createDataFrame([(1, "A", 1.0), (2, "B", 2.0)], "seq int, symbol string, net double")
    for _ in range(2):
        s.load("backtest_trade", t, "backtest", "/x/trades.csv", "2024-01-02 00:00:00")
    s.load("backtest_trade", t.limit(1), "backtest", "/x/trades.csv", "2024-01-03 00:00:00")
    assert s.read("backtest_trade").count() == 3 and s.read("load_run").count() == 2
    assert {r["table"]: r["rows"] for r in s.counts(["backtest_trade", "load_run"]).collect()} == {"backtest_trade": 3, "load_run": 2}
    with pytest.raises(ValueError, match="unknown columns"):
        s.conform("backtest_trade", t.withColumn("oops", F.lit(1)))
    t.select("symbol").write.parquet(s.path("screen_run"))
    assert "run_id" in s.drift("screen_run")["blocked"]


def test_report_frame_must_match(spark, tmp_path):
    write_report(spark.range(3), str(tmp_path / "r"), {"days": "10", "split": "2024-01-02"})
    assert report_refusals(spark, str(tmp_path / "r"), {"days": "10"}).count() == 0
    assert [r["name"] for r in report_refusals(spark, str(tmp_path / "r"), {"days": "11", "arm": "x"}).orderBy("name").collect()] == ["arm", "days"]


def test_inventory_skips_empty_and_marks_partial_files(spark, tmp_path):
    d = tmp_path / "arch" / "XNAS"
    d.mkdir(parents=True)
    (d / "2024-01-02.dbn").write_bytes(b"x")
    (d / "2024-01-03.dbn").write_bytes(b"")
    (d / "2024-01-04.dbn").write_bytes(b"x" * 5000)
    r = R.inventory(spark, str(tmp_path / "arch")).collect()[0]
    assert (r["folder"], r["files"], r["partial"], r["first_day"], r["last_day"]) == ("XNAS", 2, 1, "2024-01-02", "2024-01-04")


def sessions(spark, rows):
    return spark.createDataFrame(rows, "d string, trade long, net double").select(F.to_date("d").alias("session_date"), "trade", "net")


def by_session(rows):
    return rows.groupBy("session_date").agg(F.sum("net").alias("net"))


def test_mixed_sources_are_refused(spark):
    rows = spark.createDataFrame([("d1", "x", 1), ("d1", "x", 2), ("d2", "y", 3)], "basis string, dataset string, v int")
    assert R.unmixed(rows, ["basis"]).count() == 3
    with pytest.raises(Exception, match="mixed sources: x and z"):
        R.unmixed(rows.unionByName(spark.createDataFrame([("d1", "z", 4)], rows.schema)), ["basis"]).collect()


def test_forward_scoring_scores_completed_sessions_once(spark, tmp_path):
    root = str(tmp_path)
    rows = [("2024-01-02", 1, 1.0), ("2024-01-02", 2, 0.5), ("2024-01-03", 3, 2.0), ("2024-01-04", 4, 4.0)]
    read = lambda: {str(r["session_date"]): r["net"] for r in spark.read.parquet(f"{root}/scores").collect()}
    assert forward.score_new(sessions(spark, rows[:3]), by_session, root) == 1
    assert read() == {"2024-01-02": 1.5}
    assert forward.score_new(sessions(spark, rows[::-1]), by_session, root) == 1  # the order of rows is no change
    assert read() == {"2024-01-02": 1.5, "2024-01-03": 2.0}
    assert forward.score_new(sessions(spark, rows), by_session, root) == 0
    assert forward.early_stop(spark.read.parquet(f"{root}/scores"), 1.0, 2).collect()[0]["stopped"] is False
    assert {(str(r["session_date"]), r["run"]) for r in spark.read.parquet(f"{root}/log").collect()} == {("2024-01-02", 1), ("2024-01-03", 2)}


@pytest.mark.parametrize("change", [("2024-01-02", 1, 1.25), None])
def test_a_changed_history_is_refused(spark, tmp_path, change):
    """A scored row with another value, or gone; nothing is scored then."""
    root = str(tmp_path)
    rows = [("2024-01-02", 1, 1.0), ("2024-01-03", 3, 2.0), ("2024-01-04", 4, 4.0)]
    forward.score_new(sessions(spark, rows), by_session, root)
    with pytest.raises(forward.ChangedHistory, match="2024-01-02"):
        forward.score_new(sessions(spark, [*([change] if change else []), *rows[1:], ("2024-01-05", 5, 1.0)]), by_session, root)
    assert spark.read.parquet(f"{root}/log").count() == 2


def test_a_stream_of_sessions_is_scored_batch_by_batch(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for rows in ([("2024-01-02", 1, 1.0), ("2024-01-03", 2, 2.0)], [("2024-01-03", 3, 2.5), ("2024-01-04", 4, 4.0)]):
        sessions(spark, rows).coalesce(1).write.mode("append").parquet(src)
        forward.score_stream(spark.readStream.schema("session_date date, trade long, net double").parquet(src), by_session, root).awaitTermination()
    assert {str(r["session_date"]): r["net"] for r in spark.read.parquet(f"{root}/scores").collect()} == {"2024-01-02": 1.0, "2024-01-03": 4.5}
    with pytest.raises(Exception, match="2024-01-02"):  # a late row of a scored session
        sessions(spark, [("2024-01-02", 9, 1.0)]).write.mode("append").parquet(src)
        forward.score_stream(spark.readStream.schema("session_date date, trade long, net double").parquet(src), by_session, root).awaitTermination()


def _filled(spark, name, version, **fixed):
    """One row of a table: the given columns, the others from their type and the version."""
    from datetime import date, datetime

    from pyspark.sql import types as T

    made = {T.StringType: f"v{version}", T.DoubleType: float(version), T.IntegerType: version, T.LongType: version, T.BooleanType: True, T.DateType: date(2024, 1, 1), T.TimestampType: datetime(2024, 1, 1)}
    schema = TABLES[name].schema
    return spark.createDataFrame([tuple(fixed.get(f.name, made[type(f.dataType)]) for f in schema.fields)], schema)


@pytest.mark.parametrize("name", sorted(set(TABLES) - {"load_run"}))
def test_a_load_replaces_its_own_key_only(spark, tmp_path, name):
    from datetime import date, datetime

    other = {"string": ("a", "b"), "date": (date(2024, 1, 2), date(2024, 1, 3)), "timestamp": (datetime(2024, 1, 2, 15), datetime(2024, 1, 3, 15)), "int": (1, 2), "double": (1.0, 2.0)}
    t, store = TABLES[name], Store(spark, str(tmp_path))
    kinds = {f.name: f.dataType.simpleString() for f in t.schema.fields}
    first = {c: other[kinds[c]][0] for c in t.key}
    loads = [first] + [first | {c: other[kinds[c]][1]} for c in t.replaces]
    for fixed in loads:
        store.replace(name, _filled(spark, name, 1, **fixed))
    assert store.read(name).count() == len(loads)
    store.replace(name, _filled(spark, name, 2, **first))
    rows = store.read(name).collect()
    assert len(rows) == len(loads)
    mine = [r for r in rows if all(r[c] == v for c, v in first.items())]
    assert len(mine) == 1
    if "note" in kinds or "volume" in kinds:
        assert 2 in (mine[0].asDict().get("volume"), 2 if mine[0].asDict().get("note") == "v2" else 0)
