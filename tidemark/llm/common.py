"""Helpers the pipeline operators share: tables, shared scratch, row ids, text normalisation."""

from __future__ import annotations

import string
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ships(module: str) -> None:
    """Executors get the functions of this module with the job, so the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = 1024) -> None:
    """Small Arrow batches, since a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of a schema of plain columns."""
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(cols, fields)], [name for name, _ in fields])


def scratch(spark: SparkSession) -> str:
    """The folder executors and driver share; only a session that names none gets a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, without the lineage before it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rid(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with a column `rid`: the id where ids are present and unique, otherwise a number in the order of the ids, nulls first.

    The test reads the id column alone. Only a table with null or repeated ids is written again, sorted by
    id and place, so that the rows of one id, or without any, are dealt to many tasks.
    """
    repeats = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count()
    if not repeats:
        return docs.withColumn("rid", F.col(id_col).cast("bigint"))
    order = docs.withColumn("_place", F.monotonically_increasing_id()).orderBy(F.asc_nulls_first(id_col), "_place").drop("_place")
    return written(order.withColumn("rid", F.monotonically_increasing_id()), "rows")


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with `pos`, their place from 0 within their group by `order`, and `total`, the rows of the group.

    One sort by range deals even a single group to all tasks; what each task has of a group is counted,
    and the counts before it (a row a task and group) are added to the row's number in its task.
    """
    ranged = rows.withColumn("_place", F.monotonically_increasing_id()).orderBy(group, *order, "_place").drop("_place")
    seen = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_task", F.expr("_at >> 33"))
    spans = seen.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select(group, "_task", "_first", before.alias("_before"), F.sum("_n").over(of).alias("total")), "spans")
    return seen.join(spans, [group, "_task"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_first", "_before")


def row_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text) of docs, a null text as the empty one."""
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_rid(base, "id").select("rid", "id", "text")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, text, doc) of docs, doc being the whole row."""
    return with_rid(docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("doc")), "id")


def lower_az(text: Column) -> Column:
    """A-Z lowered and no other letter. lower() does just that for ASCII texts, and fast."""
    upper = string.ascii_uppercase
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


ships(__name__)
