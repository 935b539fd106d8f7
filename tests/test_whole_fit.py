"""Models are fitted on every row, and the trees' thresholds come from every row."""

from pyspark.sql import functions as F

from tidemark.operators import stats as T


def test_the_report_fits_every_row_not_held_out(spark):
    df = spark.range(6000).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.col("id") % 7).alias("x"))
    for r in T.classifier_report(df, ["x"], "y", "id").collect():
        assert r.fitted > 3500 and r.fitted + r.held_out == 6000


def test_a_single_row_of_40000_gives_a_threshold(spark):
    # Each feature is above zero in one row, which is positive; a draw of 10,000 rows misses most of them.
    k, names = F.col("id"), ["a", "b", "c", "d"]
    ones = [k == 9000 * i + 77 for i in range(4)]
    y = (k % 1000 == 3) | ones[0] | ones[1] | ones[2] | ones[3]
    df = spark.range(40000).select(*[o.cast("double").alias(n) for o, n in zip(ones, names)], y.cast("int").alias("y"))
    weights = T.fit_classifier(df, names, "y", 2, "boosted").bestModel.stages[-1].featureImportances.toArray()
    assert (weights > 0).all(), weights


def test_edges_cut_rows_and_distinct_values(spark):
    # Nine rows in ten are zero; the others have a value each. `few` has three values, one of them a single row's; gaps are left out.
    k = F.col("id")
    many, few = F.when(k % 10 == 0, k.cast("double")).otherwise(0.0), F.when(k == 5, 2.0).when(k % 2 == 0, 1.0).otherwise(0.0)
    df = spark.range(12800).select(many.alias("many"), few.alias("few"), F.when(k % 2 == 0, F.lit(float("nan"))).when(k % 3 == 0, k).alias("gaps"))
    got = T.bin_edges(df, ["many", "few", "gaps"])
    assert got["few"] == [0.0, 1.0, 2.0]
    assert got["many"][0] == 0.0 and got["many"][-1] == 12790.0 and 32 <= len(got["many"]) <= 64
    assert all(e % 6 == 3 for e in got["gaps"]) and len(got["gaps"]) == 32
