"""Parameter grids: a small table of cells exploded onto prepared columns, so one scan serves every
cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import windows as W


def cells(**axes: Sequence) -> list[dict]:
    """All combinations of the axes in written order."""
    out: list[dict] = [{}]
    for name, values in axes.items():
        out = [{**c, name: v} for c in out for v in values]
    return out


def with_cells(df: DataFrame, grid: Sequence[dict]) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in grid])
    return df.withColumn("__c", F.explode(rows)).select(*df.columns, "__c.*")


def exit_grid(entries: DataFrame, bars: DataFrame, grid: Sequence[dict], by: Sequence[str] = W.SESSION) -> DataFrame:
    """Result per (stop, target) cell. Entry and bar rows meet once; each cell keeps only its first
    hit, read as conditional minima on the same pass."""
    pairs = L.later_bars(entries.drop("stop_px", "target_px"), bars, by)
    o, h, l, c, e = (F.col(x) for x in ("b_open", "b_high", "b_low", "b_close", "entry_px"))
    aggs = []
    for k, cell in enumerate(grid):
        stop, target = e * (1 - cell["stop"]), e * (1 + cell["target"])
        px = F.when(l <= stop, F.least(stop, o)).when(h >= target, F.greatest(target, o))
        aggs.append(F.min(F.when(px.isNotNull(), F.struct(F.col("j").alias("j"), px.alias("px")))).alias(f"__x{k}"))
    g = pairs.groupBy(*by, "entry_id").agg(F.max("entry_px").alias("entry_px"), F.max_by("b_close", "j").alias("__end"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(cell["stop"])).alias("stop"), F.lit(float(cell["target"])).alias("target"),
                              (F.try_divide(F.coalesce(F.col(f"__x{k}.px"), F.col("__end")), F.col("entry_px")) - 1).alias("ret")) for k, cell in enumerate(grid)])
    return g.select(*by, "entry_id", F.explode(rows).alias("r")).select(*by, "entry_id", "r.*")


def grid_report(results: DataFrame, axes: Sequence[str], min_trades: int = 1) -> DataFrame:
    """Every cell, refused ones marked and never sorted by result, with the share of positive cells."""
    g = results.groupBy(*axes).agg(F.count(F.lit(1)).alias("trades"), F.sum("ret").alias("total"), F.avg("ret").alias("mean"))
    all_cells = Window.partitionBy()
    return g.withColumn("refused", F.col("trades") < min_trades).withColumn("share_positive", F.avg((F.col("total") > 0).cast("int")).over(all_cells))


def sleeves(parts: Sequence[tuple[str, float, DataFrame]]) -> DataFrame:
    """Weighted pool of daily sleeves."""
    rows = [df.select("date", F.lit(name).alias("sleeve"), F.lit(float(w)).alias("weight"), F.col("value")) for name, w, df in parts]
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    return u.groupBy("date").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.count(F.lit(1)).alias("sleeves"))


def coverage(wanted: DataFrame, found: DataFrame, on: Sequence[str], max_missing: float, reason: Column | None = None) -> DataFrame:
    """Requested against available, missing by reason, refused over the allowed share."""
    f = found.select(*on).distinct().withColumn("__f", F.lit(1))
    status = F.when(F.col("__f").isNotNull(), "found").otherwise(reason if reason is not None else F.lit("missing"))
    g = wanted.join(f, list(on), "left").withColumn("status", status).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    miss = F.sum(F.when(F.col("status") != "found", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return g.withColumn("missing_share", miss).withColumn("refused", miss > max_missing)
