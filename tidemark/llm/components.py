"""Connected components by alternating large-star and small-star rounds, each round a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join meets plain tables and the rows of a hub can be split.
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    best = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(best, "u")
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(best.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the smallest node that can be reached."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was, mark = None, _mark(now)
    while mark[0] and mark != was:
        now = written(_stars(now), "stars")
        was, mark = mark, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
