"""The store: typed parquet tables, replaced by key, with provenance."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.schemas import TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def conform(self, name: str, df: DataFrame) -> DataFrame:
        """The table's columns in order and type; columns an older source lacks become NULL and an
        unknown column is an error."""
        fields = TABLES[name].schema.fields
        extra = set(df.columns) - {f.name for f in fields}
        if extra:
            raise ValueError(f"{name}: unknown columns {sorted(extra)}")
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def held(self, name: str) -> DataFrame | None:
        """The stored rows, or None before the first load."""
        try:
            rows = self.read(name)
            rows.limit(0).count()
        except Exception as e:  # noqa: BLE001 - only a missing path means an empty table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return rows

    def replace(self, name: str, df: DataFrame) -> None:
        """Write rows in place of those stored for the same run or keys; loading twice changes nothing.

        A partition is rewritten as a whole, so the rows of other keys in the touched partitions are
        carried over, through a staged copy.
        """
        t = TABLES[name]
        rows = self.conform(name, df)
        held = None if t.replaces == (t.partition,) else self.held(name)
        spread = [k for k in (t.partition, *[k for k in t.key if k != t.partition][:1]) if k]
        if held is not None:
            kept = held.join(rows.select(t.partition).distinct(), t.partition, "left_semi") if t.partition else held
            # One shuffle deals out stored and new rows; a key with new rows keeps only those.
            both = kept.select(*rows.columns, F.lit(0).alias("__new")).unionByName(rows.withColumn("__new", F.lit(1)))
            both = both.repartition(*([k for k in spread if k in t.replaces] or t.replaces))
            both = both.withColumn("__last", F.max("__new").over(Window.partitionBy(*t.replaces))).filter("__new = __last")
            staged = f"{self.root}/_staging/{name}-{uuid.uuid4().hex}"
            both.select(*rows.columns).write.parquet(staged)
            rows = self.spark.read.schema(t.schema).parquet(staged)
        elif t.partition:
            rows = rows.repartition(*spread)
        w = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (w.partitionBy(t.partition) if t.partition else w).parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        """Rows whose key is not stored yet."""
        rows = self.conform(name, df)
        held = self.held(name)
        if held is not None:
            rows = rows.join(held.select(*TABLES[name].key), list(TABLES[name].key), "left_anti")
        rows.write.mode("append").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name].schema).parquet(self.path(name))

    def load(self, name: str, df: DataFrame, kind: str, source: str, mtime: str) -> str:
        """Replace one run and note it. A changed file has a new run id; an unchanged one is a no-op
        in effect because the same partition is rewritten."""
        run_id = f"{kind}:{source.rsplit('/', 1)[-1]}:{mtime}"
        rows = df.withColumn("run_id", F.lit(run_id)) if "run_id" in [f.name for f in TABLES[name].schema.fields] else df
        self.replace(name, rows)
        stamp = F.to_timestamp(F.lit(mtime))
        note = rows.agg(F.count(F.lit(1)).cast("int").alias("rows")).select(
            F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.lit(source).alias("source_path"), stamp.alias("source_mtime"), F.current_timestamp().alias("loaded_at"), "rows")
        self.append("load_run", note)
        return run_id

    def counts(self, names: Sequence[str]) -> DataFrame:
        parts = [self.read(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
        return reduce(DataFrame.unionByName, parts)

    def drift(self, name: str) -> dict[str, list[str]]:
        """Model columns the stored files lack: safely addable ones and key columns."""
        stored = set(self.spark.read.parquet(self.path(name)).columns)
        lack = [f.name for f in TABLES[name].schema.fields if f.name not in stored]
        return {"addable": [c for c in lack if c not in TABLES[name].key], "blocked": [c for c in lack if c in TABLES[name].key]}


def drift_rows(store: Store, names: Sequence[str]) -> DataFrame:
    """table, column, kind: the model's columns that stored tables lack; a key column cannot be added."""
    rows = [(n, c, kind) for n in names for kind, cols in (("addable", store.drift(n)["addable"]), ("blocked", store.drift(n)["blocked"])) for c in cols]
    return store.spark.createDataFrame(rows, "table string, column string, kind string")


def write_report(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Ledger as CSV beside a one-row frame of the run it belongs to."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    spark = df.sparkSession
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()]).write.mode("overwrite").json(f"{path}/meta")


def report_refusals(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """Meta values that differ from what a reader expects; empty when the report may be read."""
    m = spark.read.json(f"{path}/meta")
    rows = F.array(*[F.struct(F.lit(k).alias("name"), (F.col(k) if k in m.columns else F.lit(None)).cast("string").alias("found"), F.lit(v).alias("expected")) for k, v in expected.items()])
    return m.select(F.explode(rows).alias("r")).select("r.*").filter(~F.col("found").eqNullSafe(F.col("expected")))
