"""Two-level forms of operations that would otherwise pull one key into one task.

A window over an unbounded key sorts the whole key in a single task. Each helper here splits
the key into buckets that are a function of the row alone (time bucket, hash prefix, value
range), aggregates the buckets, runs the ordered step over the small bucket table, and adds the
bucket's offset to the row's position inside its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import micros

EDGES = 16


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys, keeping one copy of each key."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__r_{k}"), keys, right)
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, cond), how).drop(*[f"__r_{k}" for k in keys])


def time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_edges(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, back: int = 1, ahead: int = 0) -> DataFrame:
    """Rows with their bucket `__b`, and with the rows just outside each bucket as seeds (`__seed`).

    A window over (by, __b) then sees up to `back` rows before and `ahead` rows after each row as one
    over the whole key would; the caller drops the seeds. The last `back` rows of a bucket go to the
    next `back` buckets that hold rows, so short buckets lose nothing.
    """
    rows = df.withColumn("__b", bucket)
    keys = [*by, "__b"]
    line = Window.partitionBy(*by).orderBy("__b")
    held = rows.select(*keys).distinct()
    parts = [rows.withColumn("__seed", F.lit(False))]
    for n, move, turn in ((back, F.lead, F.desc), (ahead, F.lag, F.asc)):
        if n:
            to = held.withColumn("__to", F.array_compact(F.array(*[move("__b", k).over(line) for k in range(1, n + 1)])))
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[turn(c) for c in order]))
            edge = rows.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r").join(to, keys)
            parts.append(edge.withColumn("__b", F.explode("__to")).drop("__to").withColumn("__seed", F.lit(True)))
    return reduce(DataFrame.unionByName, parts)


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    bucket: Column,
) -> DataFrame:
    """Running totals per key in `order`, with the key split by an order-preserving bucket.

    `sums` maps output column to input column. The bucket totals are small: one row per key and
    bucket. Rows and offsets are joined on (key, bucket), the same distribution the inner window
    needs, so the input is shuffled once.
    """
    rows = df.withColumn("__b", bucket)
    totals = rows.groupBy(*by, "__b").agg(*[F.sum(src).alias(f"__o_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "__b",
        *[F.coalesce(F.sum(f"__o_{out}").over(before), F.lit(0)).alias(f"__p_{out}") for out in sums],
    )
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*by, "__b"])
    for out, src in sums.items():
        joined = joined.withColumn(out, F.sum(src).over(inner) + F.col(f"__p_{out}"))
    return joined.drop("__b", *[f"__p_{out}" for out in sums])


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: str, out: str, value: Column, inclusive: bool) -> DataFrame:
    """Running maximum of value per key in `order`, with the key split by an order-preserving bucket column."""
    rows = df.withColumn("__v", value)
    tops = rows.groupBy(*by, bucket).agg(F.max("__v").alias("__t"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, bucket, F.max("__t").over(before).alias("__p"))
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.join(tops, [*by, bucket]).withColumn(out, F.greatest(F.max("__v").over(inner), F.col("__p"))).drop("__v", "__p")


def hash_ordinal(
    df: DataFrame, by: Sequence[str], key: Column, out: str = "ordinal", digits: int = 2
) -> DataFrame:
    """1-based position of each row in the order of md5(key) within `by`.

    The leading hex digits of the digest split each group into equal parts, so no part holds
    more than 16^-digits of its group; the digest order is the same in any SQL engine.
    """
    rows = df.withColumn("__h", F.md5(key.cast("string"))).withColumn("__b", F.substring("__h", 1, digits))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__p"))
    inner = Window.partitionBy(*by, "__b").orderBy("__h")
    return (
        rows.join(offsets, [*by, "__b"])
        .withColumn(out, (F.row_number().over(inner) + F.col("__p")).cast("bigint"))
        .drop("__h", "__b", "__p")
    )


def value_edges(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """`__edges` per group: EDGES**2 - 1 values that cut its distinct values into parts of like size, from a quantile sketch."""
    cuts = [k / EDGES**2 for k in range(1, EDGES**2)]
    return counts.groupBy(*by).agg(F.percentile_approx(value, cuts, 8 * EDGES**2).alias("__edges"))


def edge_bucket(value: str) -> Column:
    """How many edges lie below the value, looked up in two steps: every EDGES-th edge, then those after it."""
    below = lambda e: e < F.col(value)
    coarse = F.size(F.filter(F.array(*[F.element_at("__edges", EDGES * k) for k in range(1, EDGES)]), below))
    return (coarse * EDGES + F.size(F.filter(F.slice("__edges", coarse * EDGES + 1, F.lit(EDGES - 1)), below))).cast("int")


def cumulative_counts(
    counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str]
) -> DataFrame:
    """For distinct values with weights: weight strictly below each value, per group.

    `counts` must already be one row per (group, value). Adds `<weight>_below`.
    """
    edges = value_edges(counts, by, value)
    ranged = null_safe_on(counts, edges, by) if by else counts.crossJoin(F.broadcast(edges))
    rows = ranged.withColumn("__b", edge_bucket(value)).drop("__edges")
    totals = rows.groupBy(*by, "__b").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "__b", *[F.coalesce(F.sum(f"__t_{w}").over(before), F.lit(0)).alias(f"__p_{w}") for w in weights]
    )
    inner = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_on(rows, offsets, [*by, "__b"])
    for w in weights:
        joined = joined.withColumn(f"{w}_below", F.coalesce(F.sum(w).over(inner), F.lit(0)) + F.col(f"__p_{w}"))
    return joined.drop("__b", *[f"__p_{w}" for w in weights])


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles of unbounded groups, one column per name.

    Rows are folded to (group, value, count) by a combining aggregate, ranked with
    `cumulative_counts`, and only the values whose rank interval covers a wanted rank are kept.
    method: 'linear' interpolates at q*(n-1); 'lower' takes index int(q*(n-1)).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative_counts(counts, by, value, ["n"])
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("__size"))
    rows = null_safe_on(ranked, sizes, by) if by else ranked.crossJoin(F.broadcast(sizes))
    at = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("__size") - 1)
        low = F.floor(pos)
        high = F.ceil(pos) if method == "linear" else low
        inside = lambda r: (F.col("n_below") <= r) & (r < F.col("n_below") + F.col("n"))
        at.append(F.max(F.when(inside(low), F.col(value))).alias(f"__l_{name}"))
        at.append(F.max(F.when(inside(high), F.col(value))).alias(f"__h_{name}"))
        at.append(F.max(pos - low).alias(f"__f_{name}"))
    picked = rows.groupBy(*by).agg(F.max("__size").alias("n"), *at)
    cols = []
    for name in quantiles:
        lo, hi, frac = F.col(f"__l_{name}"), F.col(f"__h_{name}"), F.col(f"__f_{name}")
        cols.append((lo + (hi - lo) * (frac if method == "linear" else F.lit(0.0))).alias(name))
    return picked.select(*by, "n", *cols)
