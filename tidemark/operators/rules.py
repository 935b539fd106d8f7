"""The rule surface: named rules over bars, gates as boolean columns and per-session maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import signals as X
from tidemark.operators import windows as W

Rule = Callable[[DataFrame], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a DataFrame -> DataFrame rule that adds a boolean column of its own name."""

    def keep(fn: Rule) -> Rule:
        RULES[name] = fn
        return fn

    return keep


@rule("channel")
def channel(df: DataFrame) -> DataFrame:
    top = W.prior(F.max, "high", W.DAY, "date", 20)
    return df.withColumn("channel", F.coalesce(F.col("close") > top, F.lit(False)))


@rule("rising")
def rising(df: DataFrame) -> DataFrame:
    return df.withColumn("rising", W.rising("close"))


@rule("dip")
def dip(df: DataFrame) -> DataFrame:
    hits = X.impulse_dips(df, by=W.DAY, order="date").select("symbol", "date", F.lit(True).alias("dip"))
    return df.join(hits, ["symbol", "date"], "left").na.fill(False, ["dip"])


def apply_rules(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for n in names:
        df = RULES[n](df)
    return df


def gated(entries: DataFrame, gate: DataFrame, on: Sequence[str]) -> DataFrame:
    """Entries with a gate's boolean column; a bar without a gate row is refused."""
    flags = [c for c in gate.columns if c not in on]
    return entries.join(gate, list(on), "left").na.fill(False, flags)


def map_sessions(bars: DataFrame, fn: Callable, schema: str, by: Sequence[str] = W.SESSION) -> DataFrame:
    """A pandas function per symbol-session; a session's bars are bounded by the clock."""
    return bars.groupBy(*by).applyInPandas(fn, schema)
