"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of BITS bits is cut into segments of about log2(codes) - FILL bits, so that a probe meets some
2**FILL codes, and the index holds each distinct code once under every segment's value. All queries probe the index with their segments changed in 0
bits, then in 1, and so on. After radius r every code within segments * (r + 1) - 1 bits has been met,
since a code further than r in every segment is further than that in all. A query stops when its k-th
verified distance is within this bound, which proves its answer; no query stops earlier.

A code is taken where it is met first (least radius, then first segment), so no pair is verified twice
and nothing needs deduplicating. Copies of a vector are one index entry with the k smallest of their
ids, since no other of them can be among the k nearest; queries with equal codes are answered once.
Ties are broken by the smaller id.

Defined results: a null or empty vector is the code zero; component j sets bit j modulo BITS when it is
above zero (a second one on the same bit flips it). Rows with a null id are neither queries nor answers.
A query is itself an answer when it is in the table. Fewer than k rows give fewer answers.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

BITS = 64
K = 10
QUERY_STEP = 20
FILL = 3


def code_of(vector: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    bits = F.transform(vector, lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), k % BITS)).otherwise(zero))
    return F.coalesce(F.aggregate(bits, zero, lambda a, b: a.bitwiseXOR(b)), zero)


def segment_bounds(codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    m = max(2, round(bits / max(1.0, math.log2(max(2, codes)) - FILL)))
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def changed(value: Column, masks: list[int]) -> Column:
    """The value with each mask's bits changed."""
    listed = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")  # one literal once folded
    return F.transform(listed, lambda mask: value.bitwiseXOR(mask))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best codes of each query code by distance, then by smallest id: enough for the k best rows."""
    order = Window.partitionBy("q").orderBy("d", "low")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, distance: the k rows of `vectors` nearest to each row of `queries`."""

    def codes(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), code_of(F.col(vector_col)).alias("code"))

    ranked = codes(vectors).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    entries = written(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("low", F.element_at("ids", 1)), "codes")
    asked = written(codes(queries).withColumnRenamed("id", "query_id"), "queries")
    bounds = segment_bounds(entries.count())
    cuts = F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col("code"), *b).alias("key")) for s, b in enumerate(bounds)])
    index = written(entries.select("code", "ids", "low", F.explode(cuts).alias("c")).select("c.s", "c.key", "code", "ids", "low"), "index")
    active = asked.select(F.col("code").alias("q")).distinct()
    held = None
    done = []
    for radius in range(max(w for _, w in bounds) + 1):
        probes = F.array(*[F.struct(F.lit(s).alias("s"), changed(segment(F.col("q"), a, w), flips(w, radius)).alias("keys")) for s, (a, w) in enumerate(bounds) if radius <= w])
        asking = active.select("q", F.explode(probes).alias("p")).select("q", "p.s", F.explode("p.keys").alias("key"))
        # Probes are many more than the query codes whose size the planner sees: never a broadcast.
        met = asking.hint("merge").join(index, ["s", "key"])
        apart = F.col("q").bitwiseXOR(F.col("code"))
        first = [F.struct(F.bit_count(segment(apart, a, w)).alias("r"), F.lit(s).alias("s")) for s, (a, w) in enumerate(bounds)]
        new = met.where(F.least(*first)["s"] == F.col("s")).select("q", "code", "ids", "low", F.bit_count(apart).alias("d"))
        held = written(best(new if held is None else held.join(active, "q", "left_semi").union(new), k), f"radius{radius}")
        covered = len(bounds) * (radius + 1) - 1
        proved = held.where(F.col("d") <= covered).groupBy("q").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= k).select("q")
        done.append(held.join(proved, "q", "left_semi"))
        active = written(active.join(proved, "q", "left_anti"), f"active{radius}")
        if not active.limit(1).count():
            break
    else:
        done.append(held.join(active, "q", "left_semi"))
    answers = done[0]
    for part in done[1:]:
        answers = answers.union(part)
    rows = answers.select("q", "d", F.explode("ids").alias("id")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("rank") <= k)
    return asked.join(rows, asked["code"] == rows["q"]).select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias(id_col), F.col("d").cast("bigint").alias("distance"))


def oracle(k: int = K) -> str:
    return f"""
WITH codes AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END FOR i IN range(1, 65)])::HUGEINT AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code)) AS distance FROM codes q, codes v WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, CAST(distance AS BIGINT) AS distance
FROM pairs QUALIFY rank <= {k}
"""
