"""Readers: bars, pair lists, execution reports, fill logs, facts, memberships, headlines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources.schemas import EXECUTION_REPORT


PAIR_JSON = "symbol string, date string"


def bars(spark: SparkSession, paths: Sequence[str] | str, symbol: str = "symbol") -> DataFrame:
    """Bar files of one schema as one table. A file in which no symbol resolved is refused; the
    check is part of the scan, so it costs no second pass and fails the job that reads it."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return require(df, F.col(symbol).isNotNull(), f"unresolved {symbol}")


def require(df: DataFrame, ok: Column, why: str) -> DataFrame:
    """Fails the reading job on the first row that breaks a rule."""
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(why)).cast("boolean")))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in a written order; a combining aggregate, not a window."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__s"), F.count(F.lit(1)).alias("copies"))
    return one.select(*key, *[F.col(f"__s.{c}").alias(c) for c in rest], "copies")


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__s"))
    return one.select(*key, *[F.col(f"__s.{c}").alias(c) for c in rest])


def complete_dates(slices: DataFrame, date: str, window: str, need: int) -> DataFrame:
    """Dates that have every required intraday window."""
    return slices.groupBy(date).agg(F.count_distinct(window).alias("windows")).filter(F.col("windows") >= need)


def pairs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(symbol, date) lists from JSON files, de-duplicated, US equities only."""
    return pair_rows(spark.read.schema(PAIR_JSON).option("multiLine", True).json(list(paths)))


def pair_rows(raw: DataFrame) -> DataFrame:
    s = X.vendor_symbol(F.col("symbol"))
    return raw.select(s.alias("symbol"), F.to_date("date").alias("session_date")).filter(
        F.col("symbol").rlike(r"^[A-Z]{1,5}(\.[A-Z])?$") & F.col("session_date").isNotNull()).distinct()


def executions(spark: SparkSession, paths: Sequence[str], stocks_only: bool = True) -> DataFrame:
    """Execution rows of overlapping broker reports, one per trade id.

    De-duplication is on the id alone, since two child fills may be equal in every value; a missing
    id fails the read.
    """
    return execution_rows(spark.read.schema(EXECUTION_REPORT).option("header", True).csv(list(paths)), stocks_only)


def execution_rows(raw: DataFrame, stocks_only: bool = True) -> DataFrame:
    rows = raw.filter(F.col("LevelOfDetail") == "EXECUTION")
    if stocks_only:
        rows = rows.filter(F.col("AssetClass") == "STK")
    rows = require(rows, F.col("TradeID").isNotNull(), "execution without a trade id")
    stamp = X.report_stamp(F.col("DateTime"))
    return rows.dropDuplicates(["TradeID"]).select(
        F.col("TradeID").alias("trade_id"), X.vendor_symbol(F.col("Symbol")).alias("symbol"), F.to_date("TradeDate", "yyyyMMdd").alias("trade_date"),
        stamp.alias("dt_raw"), F.abs("Quantity").alias("qty"), F.col("TradePrice").alias("price"), F.col("IBCommission").alias("commission"),
        F.col("FifoPnlRealized").alias("fifo_pnl"), F.upper("Buy/Sell").alias("side"), stamp.isNotNull().alias("time_known"))


def fill_logs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Live fill logs of several column generations; each file is read by its own header."""
    return log_rows([spark.read.option("header", True).csv(p).withColumn("source_file", F.input_file_name()) for p in paths])


def log_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Generations as one table; a column an older one lacks is NULL, the date is in the file's name."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    day = F.regexp_extract("source_file", r"(\d{4}-\d{2}-\d{2})", 1)
    return u.withColumn("session_date", F.to_date(F.nullif(day, F.lit(""))))


FACT_JSON = "taxonomy string, tag string, cik bigint, units map<string, array<struct<start:string, end:string, filed:string, form:string, val:double>>>"


def concept_facts(df: DataFrame, body: str = "body") -> DataFrame:
    """Company-concept JSON flattened to one row per reported value, both dates kept."""
    j = df.withColumn("__j", F.from_json(body, FACT_JSON)).select("__j.cik", "__j.taxonomy", "__j.tag", F.explode("__j.units").alias("unit", "rows"))
    return j.select("cik", "taxonomy", "tag", "unit", F.explode("rows").alias("r")).select(
        "cik", "taxonomy", "tag", "unit", F.to_date("r.start").alias("start"), F.to_date("r.end").alias("end"), F.to_date("r.filed").alias("filed"), "r.form", "r.val")


MEMBER_JSON = "map<string, struct<Code:string, StartDate:string, EndDate:string, IsActiveNow:int>>"


def constituents(df: DataFrame, index: str, body: str = "body") -> DataFrame:
    """Membership spells of an index; a missing end date is an open spell."""
    r = df.select(F.explode(F.map_values(F.from_json(body, MEMBER_JSON))).alias("r"))
    end = F.to_date("r.EndDate")
    return r.select(F.lit(index).alias("index"), X.vendor_symbol(F.col("r.Code")).alias("code"), F.to_date("r.StartDate").alias("start"), end.alias("end"), end.isNull().alias("active"))


HEADLINE_CSV = "symbol string, headline string, created_at string, symbol_count int"
FILING_CSV = "symbol string, form string, items string, accepted string"


def headlines(spark: SparkSession, path: str) -> DataFrame:
    return headline_rows(spark.read.schema(HEADLINE_CSV).option("header", True).csv(path))


def headline_rows(raw: DataFrame) -> DataFrame:
    return raw.select("symbol", "headline", X.utc_stamp(F.col("created_at")).alias("created_at"), "symbol_count", X.headline_label(F.col("headline")).alias("label"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    return filing_rows(spark.read.schema(FILING_CSV).option("header", True).csv(path))


def filing_rows(raw: DataFrame) -> DataFrame:
    return raw.select("symbol", "form", "items", X.edgar_stamp(F.col("accepted")).alias("accepted"), X.filing_labels(F.col("form"), F.col("items")).alias("labels"))


def inventory(spark: SparkSession, root: str, partial_below: int = 1024) -> DataFrame:
    """File counts, sizes, suspiciously small files and date coverage per dataset folder, from file
    metadata only. The file source skips files of no bytes, so an empty day shows as missing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    day = F.nullif(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    folder = F.element_at(F.split("path", "/"), -2)
    return f.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count(F.when(F.col("length") < partial_below, 1)).alias("partial"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def warmup_windows(bars: DataFrame, wanted: DataFrame, sessions: DataFrame, back: int = 2) -> DataFrame:
    """Bars of each wanted (symbol, date) and of the `back` sessions before it, by session ordinal."""
    s = sessions.select(F.col("date").alias("session_date"), "ordinal")
    w = wanted.join(F.broadcast(s), "session_date").select("symbol", F.col("session_date").alias("target_date"), F.col("ordinal").alias("__t"))
    w = w.withColumn("ordinal", F.explode(F.sequence(F.col("__t") - back, F.col("__t")))).drop("__t")
    days = w.join(F.broadcast(s), "ordinal").drop("ordinal")
    return days.join(bars, ["symbol", "session_date"])


def one_source(df: DataFrame, by: Sequence[str], column: str = "dataset") -> DataFrame:
    """Number of price sources per basis and whether they may be mixed: only one source is accepted."""
    return df.groupBy(*by).agg(F.count_distinct(column).alias("sources")).withColumn("accepted", F.col("sources") <= 1)


def unmixed(df: DataFrame, by: Sequence[str], column: str = "dataset") -> DataFrame:
    """df, refused as a whole if any basis holds rows of two sources: the job that reads it fails, naming both."""
    basis = df.groupBy(*by).agg(F.min(column).alias("__a"), F.max(column).alias("__b"))
    same = F.when(F.col("__a").eqNullSafe(F.col("__b")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("mixed sources: "), F.col("__a").cast("string"), F.lit(" and "), F.col("__b").cast("string"))).cast("boolean"))
    return df.join(basis.filter(same).select(*by), list(by))


def last_generation(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
