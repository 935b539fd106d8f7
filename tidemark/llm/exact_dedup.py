"""Exact deduplication over an extendible-hash index kept as shared files.

Keys are 64-bit hashes of the normalised text. The directory of the index starts with one cell and
doubles while a bucket holds more keys than its capacity; a bucket is a key prefix, so buckets are key
ranges. Every row finds its bucket through the directory. Of keys that several rows share, the bytes are
compared by an aggregate on (bucket, key, text), whose map-side part folds the copies of a hot text to
one row per task before anything moves. The folded rows go by (bucket, key) to the task that owns their
range, which chains the different texts of a key and writes its range of the index. Rows look up their
chain by (bucket, key) and their entry in it by the text's digest.

Defined results: a null text counts as empty, and empty texts are equal to each other. Rows that repeat
both id and text are one document and share one verdict. A null id never wins over another; a group of
null ids only keeps all of them (keep_id null, kept true). Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_az, row_ids, written

BUCKET_KEYS = 200_000
SPARE_DEPTH = 3
BROADCAST_CELLS = 1 << 16


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(cell, depth, bucket) for each cell of the directory, and the directory's global depth.

    A cell is a prefix of global depth; its bucket is the shortest prefix of it that holds at most
    `capacity` keys, or the cell itself when even that is overfull.
    """
    n = keys.count()
    depth = max(0, math.ceil(math.log2(max(1.0, n / capacity)))) + (SPARE_DEPTH if n > capacity else 0)
    cell = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")
    cells = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    ladder = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - level)"))
    sizes = ladder.groupBy("level", "prefix").agg(F.sum("n").alias("held"))
    fits = ladder.join(sizes, ["level", "prefix"]).where((F.col("held") <= capacity) | (F.col("level") == depth))
    chosen = fits.groupBy("cell").agg(F.min("level").alias("depth"))
    return chosen.select("cell", "depth", F.concat_ws(":", F.col("depth").cast("string"), F.expr(f"shiftrightunsigned(cell, {depth} - depth)").cast("string")).alias("bucket")), depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256, bucket: one row per row of docs."""
    return numbered_groups(row_ids(docs, id_col, text_col), capacity).drop("rid").withColumnRenamed("id", id_col)


def one_each(rows: DataFrame) -> DataFrame:
    """rid of one row of each group of equal texts in rows (rid, id, text): the largest id, of equals the first row."""
    return numbered_groups(rows).where("kept").groupBy("text_sha256").agg(F.min("rid").alias("rid")).select("rid")


def numbered_groups(rows: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    norm = lower_az(F.col("text"))
    digests = written(rows.select("rid", "id", F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("sha")), "digests")
    # Written, so that the join below meets plain tables and a hot key's rows can be split.
    keys = written(digests.groupBy("key").agg(F.count("*").alias("n")), "keys")
    book, depth = directory(keys, capacity)
    cell = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")
    book = written(book.select("cell", "bucket"), "directory")
    placed = digests.withColumn("cell", cell).join(F.broadcast(book) if 1 << depth <= BROADCAST_CELLS else book, "cell").drop("cell")
    shared = placed.join(keys.where("n > 1").select("key"), "key").select("rid", "key", "bucket")
    texts = rows.select("rid", "id", "text").join(shared, "rid").select("bucket", "key", "id", norm.alias("norm"))
    folded = texts.groupBy("bucket", "key", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = folded.select("bucket", "key", F.struct(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").alias("entry"))
    owned = entries.repartitionByRange("bucket", "key").groupBy("bucket", "key")  # the ranges' owners group without another exchange
    index = written(owned.agg(F.collect_list("entry").alias("chain")).sortWithinPartitions("bucket", "key"), "index")
    found = placed.join(index, ["bucket", "key"], "left").withColumn("entry", F.get(F.filter("chain", lambda e: e["sha"] == F.col("sha")), F.lit(0)))
    alone = F.col("entry").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("entry.keep_id"))
    return found.select(
        "rid", "id", keep.alias("keep_id"), F.coalesce("entry.group_size", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket",
    )


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
