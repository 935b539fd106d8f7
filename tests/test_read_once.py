"""Steps that read a costly input several times compute it once."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import stats as T
from tidemark.sources.store import Store


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_read_written_counts(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"), (F.col("id") - 40).alias("net"))
    for by in ((), ("g",)):
        got = T.quantile_buckets(df, "v", 4, "net", by)
        assert "Range (" not in plan(got)
        assert sorted(r.n for r in got.collect()) == ([25] * 4 if not by else [12] * 4 + [13] * 4)
    split = spark.range(100).select(F.when(F.col("id") < 30, 0.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("net"), (F.col("id") % 1).alias("g"))
    both = split.union(df.select("v", "net", F.lit(5).alias("g")))
    assert T.quantile_buckets(split, "v", 4, "net").count() == 0
    assert {r.g for r in T.quantile_buckets(both, "v", 4, "net", ["g"]).collect()} == {5}


def test_classifiers_read_written_features(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(3)).alias("x"))
    got = T.classifier_report(df, ["x"], "y", "id", limit=100)
    assert "Range (" not in plan(got)
    assert {r.kind: r.fitted for r in got.collect()} == {"logit": 100, "boosted": 100}


def test_loading_twice_changes_nothing_for_a_key_with_nulls(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ddl = "dataset string, symbol string, session_date date, close double"
    rows = spark.createDataFrame([("A", s, None if s == "z" else date(2024, 1, d), float(d)) for s in "xyz" for d in (2, 3)][:5], ddl)
    store.replace("bar_daily", rows)
    store.replace("bar_daily", rows.withColumn("close", F.col("close") + 1))
    got = sorted((r.symbol, str(r.session_date), r.close) for r in store.read("bar_daily").collect())
    assert got == sorted((r.symbol, str(r.session_date), r.close + 1) for r in rows.collect())
