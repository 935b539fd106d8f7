"""Greedy selection of intervals that do not overlap, per key, without walking a key in one task.

1. A row that starts after every earlier row of its key has ended begins an island; nothing before it
   matters to what follows, so islands are independent and their first row is always taken. The running
   maximum of the ends is taken in two levels, within ranges of starts and over the ranges.
2. An island of at most `crowded` rows is folded as one array.
3. In a larger one each row points to the first row that starts after its end. The rows taken are those
   the pointers lead to from the island's first row; they are found by doubling the pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scale import edge_bucket, null_safe_on, running_max, value_edges
from tidemark.session import staged

CROWDED = 10_000
#: A key of at most so many rows is folded whole; it needs no islands and no edges.
WHOLE = 1_000


def with_islands(rows: DataFrame, start: str, end: str, by: Sequence[str]) -> DataFrame:
    """rows with `__island`, the start of the island each row belongs to."""
    edges = value_edges(rows, by, start)
    placed = null_safe_on(rows, edges, by).withColumn("__range", edge_bucket(start)).drop("__edges")
    order = [start, end]
    ended = running_max(placed, by, order, "__range", "__ended", F.col(end), inclusive=False)
    opens = F.when(F.col("__ended").isNull() | (F.col(start) > F.col("__ended")), F.col(start))
    return running_max(ended, by, order, "__range", "__island", opens, inclusive=True).drop("__ended", "__range")


def _folded(islands: DataFrame, keys: Sequence[str], cols: Sequence[str], start: str, end: str) -> DataFrame:
    """Each island's rows, in order, with whether they are taken."""
    items = islands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("__s"), F.col(end).alias("__e"), F.struct(*cols).alias("row")))).alias("items"))
    kind = islands.schema[end].dataType.simpleString()
    begin = f"named_struct('busy', cast(null as {kind}), 'flags', cast(array() as array<boolean>))"
    free = "acc.busy is null or x.__s > acc.busy"
    flags = F.expr(f"aggregate(items, {begin}, (acc, x) -> named_struct('busy', if({free}, x.__e, acc.busy), 'flags', array_append(acc.flags, {free}))).flags")
    out = items.withColumn("flags", flags).select(F.explode(F.arrays_zip(F.col("items"), F.col("flags"))).alias("z"))
    return out.select("z.items.row.*", F.col("z.flags").alias("__taken"))


def _pointed(islands: DataFrame, keys: Sequence[str], cols: Sequence[str], start: str, end: str) -> DataFrame:
    """The same by pointers: numbered rows, the next row each points to, and the pointers doubled until none leads on."""
    rows = staged(islands.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(start, end, *[c for c in cols if c not in (start, end)]))))
    # The first row that starts after an end: rows and ends in one order, the number of the next row carried back.
    marks = rows.select(*keys, F.col(start).alias("__at"), F.lit(1).alias("__kind"), "__n").unionByName(rows.select(*keys, F.col(end).alias("__at"), F.lit(0).alias("__kind"), "__n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.asc("__kind")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = marks.withColumn("__next", F.min(F.when(F.col("__kind") == 1, F.col("__n"))).over(order)).filter("__kind = 0 AND __next IS NOT NULL")
    jump = staged(nxt.select(*keys, "__n", "__next"))
    jumps = []
    while jump.limit(1).count():
        jumps.append(jump)
        again = jump.select(*keys, F.col("__n").alias("__next"), F.col("__next").alias("__to"))
        jump = staged(jump.join(again, [*keys, "__next"]).select(*keys, "__n", F.col("__to").alias("__next")))
    reached = rows.filter("__n = 1").select(*keys, "__n")
    for jump in reversed(jumps):
        reached = staged(reached.union(reached.join(jump, [*keys, "__n"]).select(*keys, F.col("__next").alias("__n"))))
    return rows.join(reached.withColumn("__taken", F.lit(True)), [*keys, "__n"], "left").select(*cols, F.coalesce("__taken", F.lit(False)).alias("__taken"))


def non_overlapping(rows: DataFrame, start: str, end: str, by: Sequence[str], refused: str | None = None, crowded: int = CROWDED) -> DataFrame:
    """Take rows in order of (start, end) while the previous taken row has ended (its end is before the
    next start); the others are dropped, or kept with `outcome` set to `refused`."""
    cols = rows.columns
    # The edges and the ranges both read the rows; what leads to them runs once.
    keyed = staged(rows.select("*", F.struct(*by).alias("__key")))
    busy = staged(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > min(WHOLE, crowded)).select("__key"))
    marked = _folded(keyed.join(busy, "__key", "left_anti"), ["__key"], cols, start, end)
    if busy.limit(1).count():
        islands = staged(with_islands(keyed.join(busy, "__key", "left_semi"), start, end, ["__key"]))
        keys = ["__key", "__island"]
        crowds = staged(islands.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > crowded).select(*keys))
        marked = marked.unionByName(_folded(islands.join(crowds, keys, "left_anti"), keys, cols, start, end))
        if crowds.limit(1).count():
            marked = marked.unionByName(_pointed(islands.join(crowds, keys, "left_semi"), keys, cols, start, end))
    if refused is None:
        return marked.filter("__taken").drop("__taken")
    return marked.withColumn("outcome", F.when(F.col("__taken"), F.col("outcome")).otherwise(refused)).drop("__taken")
