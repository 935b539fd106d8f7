"""Data-quality and point-in-time checks: tables that must be empty, or under a bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zone_scores(execs: DataFrame, zones: Sequence[str], wall: str = "wall", date: str = "session_date") -> DataFrame:
    """For each candidate zone how many rows land in session on their trade date; best marked."""
    aggs = []
    for i, z in enumerate(zones):
        et = F.from_utc_timestamp(F.to_utc_timestamp(wall, z), "America/New_York")
        fits = (F.to_date(et) == F.col(date)) & F.hour(et).between(4, 19)
        aggs.append(F.count(F.when(fits, 1)).alias(f"f{i}"))
    one = execs.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(z).alias("zone"), F.col("n"), F.col(f"f{i}").alias("fits")) for i, z in enumerate(zones)])
    s = one.select(F.explode(rows).alias("s")).select("s.*")
    best = F.row_number().over(Window.partitionBy().orderBy(F.desc("fits"), "zone"))
    return s.withColumn("chosen", best == 1)


def outside_membership(trades: DataFrame, spells: DataFrame, date: str = "session_date") -> DataFrame:
    """Trades on a day no membership spell covers; must be empty for an honest book."""
    from tidemark.operators.joins import interval_join

    return interval_join(trades, spells, ["symbol"], date, how="left_anti")


def prefix_differences(transform, rows: DataFrame, cut: Column, keep: Column) -> DataFrame:
    """Rows of a transform that change when later input is removed: the look-ahead test."""
    whole = transform(rows).filter(keep)
    part = transform(rows.filter(cut)).filter(keep)
    return whole.exceptAll(part).unionAll(part.exceptAll(whole))


def unprinted_fills(fills: DataFrame, ticks: DataFrame, on: Sequence[str] = ("symbol", "session_date", "price")) -> DataFrame:
    printed = ticks.select("symbol", "session_date", F.col("px").alias("price")).distinct()
    return fills.join(printed, list(on), "left_anti")


def leak_verdict(measures: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Survivors against rejects: LEAK when survivors trade far more often or only they earn."""
    g = measures.agg(
        F.max(F.when(F.col("population") == "survivor", F.col("entries_per_day"))).alias("s"), F.max(F.when(F.col("population") == "reject", F.col("entries_per_day"))).alias("r"),
        F.max(F.when(F.col("population") == "survivor", F.col("net_per_trade"))).alias("sn"), F.max(F.when(F.col("population") == "reject", F.col("net_per_trade"))).alias("rn"))
    word = F.when(F.col("s").isNull() | F.col("r").isNull(), "UNKNOWN").when(F.col("s") > ratio * F.col("r"), "LEAK_RATE").when(
        (F.col("sn") > 0) & (F.col("rn") <= 0), "LEAK_QUALITY").otherwise("CLEAN")
    return g.withColumn("verdict", word)


def daily_agreement(rebuilt: DataFrame, owned: DataFrame, tick: float, pass_share: float = 0.99) -> DataFrame:
    """Share of symbol-days whose rebuilt close is within a tick of the owned one, and the gaps."""
    j = rebuilt.select("symbol", "date", F.col("close").alias("a")).join(owned.select("symbol", "date", F.col("close").alias("b")), ["symbol", "date"], "full_outer")
    near = (F.abs(F.col("a") - F.col("b")) <= tick + 1e-9).cast("int")
    return j.groupBy("symbol").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("a").isNull(), 1)).alias("missing"),
                                   F.avg(near).alias("agree")).withColumn("passes", F.col("agree") >= pass_share)


def session_assertions(bars: DataFrame, least: int) -> DataFrame:
    """Per session: bar count, order, price sanity; a row for each session that fails one."""
    g = bars.groupBy("symbol", "session_date").agg(
        F.count(F.lit(1)).alias("bars"), F.count(F.when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), 1)).alias("bad_ohlc"),
        F.count(F.when(F.col("volume") <= 0, 1)).alias("no_volume"), F.count_distinct("minute").alias("minutes"))
    why = F.array_compact(F.array(F.when(F.col("bars") < least, "short"), F.when(F.col("bad_ohlc") > 0, "ohlc"), F.when(F.col("no_volume") > 0, "volume"), F.when(F.col("minutes") < F.col("bars"), "duplicate")))
    return g.withColumn("failures", F.array_join(why, ",")).filter("failures <> ''")


def spell_coverage(spells: DataFrame, spans: DataFrame, slack: int = 7, density: float = 0.5) -> DataFrame:
    """full / partial / suspect_reuse / none per spell from the span and density of its prices.

    spans: symbol, first, last, rows.
    """
    j = spells.join(spans, "symbol", "left")
    end = F.coalesce(F.col("end"), F.col("last"))
    expected = (F.datediff(F.col("last"), F.col("first")) + 1) * 5 / 7
    kind = (
        F.when(F.col("rows").isNull(), "none").when((F.col("last") < F.col("start")) | (F.col("first") > end), "outside")
        .when(F.col("rows") < density * expected, "suspect_reuse")
        .when((F.datediff("first", "start") <= slack) & (F.datediff(end, F.col("last")) <= slack), "full").otherwise("partial"))
    return j.withColumn("coverage", kind)


def name_key(name: Column) -> Column:
    """Company name without punctuation, case and legal suffix, for exact rename matches."""
    bare = F.regexp_replace(F.lower(name), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(bare, r"\b(inc|corp|ltd|co|plc|llc|holdings)\b", ""))


def screen_found(live: DataFrame, simulated: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Share of live (symbol, ordinal) picks the simulated list has, at each session lag."""
    l = live.select("symbol", "ordinal").distinct()
    lags = F.explode(F.array(*[F.lit(o) for o in offsets]))
    want = l.withColumn("lag", lags).withColumn("ordinal", F.col("ordinal") + F.col("lag"))
    s = simulated.select("symbol", "ordinal").distinct().withColumn("__f", F.lit(1))
    g = want.join(s, ["symbol", "ordinal"], "left").groupBy("lag").agg(F.count(F.lit(1)).alias("live"), F.count("__f").alias("found"))
    w = Window.partitionBy().orderBy(F.desc("found"), F.abs("lag"), "lag")
    return g.withColumn("rate", F.col("found") / F.col("live")).withColumn("best", F.row_number().over(w) == 1)


def first_difference(frozen: DataFrame, fresh: DataFrame, ordinal: str, cols: Sequence[str]) -> DataFrame:
    """Ordered comparison of two recorded lists: rows, differing rows and the first of them."""
    a = frozen.select(ordinal, F.struct(*cols).alias("a"))
    b = fresh.select(ordinal, F.struct(*cols).alias("b"))
    j = a.join(b, ordinal, "full_outer")
    bad = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))
    return j.agg(F.count(F.lit(1)).alias("rows_seen"), F.count(F.when(bad, 1)).alias("differing"), F.min(F.when(bad, F.col(ordinal))).alias("first_bad"))


def bucket_prices(days: DataFrame, ticks: DataFrame, minutes: Sequence[int], near: int = 5) -> DataFrame:
    """Price at each clock bucket: HIT when a print is at most `near` minutes old, BACKFILL when
    older, MISSING when the session has none before it. Conditional aggregates, no as-of sort."""
    aggs = []
    for b in minutes:
        ok = F.col("minute") <= b
        aggs.append(F.max(F.when(ok, F.struct("ts", "seq", F.col("minute").alias("m"), F.col("px").alias("px")))).alias(f"b{b}"))
    g = days.join(ticks.groupBy("symbol", "session_date").agg(*aggs), ["symbol", "session_date"], "left")
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{b}.px").alias("px"), F.when(F.col(f"b{b}").isNull(), "MISSING").when(
        F.lit(b) - F.col(f"b{b}.m") <= near, "HIT").otherwise("BACKFILL").alias("status")) for b in minutes])
    return g.select("symbol", "session_date", F.explode(rows).alias("r")).select("symbol", "session_date", "r.*")


OUTCOME_WORDS = ("exit_px", "exit_price", "gross", "net", "pnl", "ret")


def assert_count_only(df: DataFrame) -> DataFrame:
    """Refuses a pre-flight table that names an outcome column."""
    named = [c for c in df.columns if c.lower() in OUTCOME_WORDS]
    if named:
        raise ValueError(f"count-only table names outcome columns: {named}")
    return df


def counts_by_year(events: DataFrame, date: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    return assert_count_only(events.groupBy(F.year(date).alias("year")).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0))


def marks_found(marks: DataFrame, entries: DataFrame, tolerance_s: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Nearest engine entry on the same key within tolerance of each mark, else missing.

    Nearest is the better of one backward and one forward as-of read.
    """
    from tidemark.functions.clock import micros
    from tidemark.operators.joins import asof_join

    e = entries.select(*by, "ts", "seq", F.col("seq").alias("entry_seq"), F.col("ts").alias("entry_at"))
    cols = ["entry_seq", "entry_at"]
    width = max(tolerance_s, 3600)
    b = asof_join(marks, e, by, cols, tolerance_s=tolerance_s, bucket_s=width)
    for c in cols:
        b = b.withColumnRenamed(c, f"b_{c}")
    f = asof_join(b, e, by, cols, direction="forward", tolerance_s=tolerance_s, bucket_s=width)
    db, df_ = micros("ts") - micros("b_entry_at"), micros("entry_at") - micros("ts")
    first = F.when(F.col("b_entry_seq").isNull(), F.col("entry_seq")).when(F.col("entry_seq").isNull() | (db <= df_), F.col("b_entry_seq")).otherwise(F.col("entry_seq"))
    return b_columns(f.withColumn("matched", first))


def b_columns(df: DataFrame) -> DataFrame:
    return df.drop("b_entry_seq", "b_entry_at", "entry_seq", "entry_at").withColumn("found", F.col("matched").isNotNull())


def rebuilt_minutes(minutes: DataFrame, folded: DataFrame) -> DataFrame:
    """Minute bars against bars folded from finer ones: missing, extra and repaired values."""
    a = minutes.select("symbol", "ts", F.col("close").alias("a"), F.col("volume").alias("va"))
    b = folded.select("symbol", "ts", F.col("close").alias("b"), F.col("volume").alias("vb"))
    return a.join(b, ["symbol", "ts"], "full_outer").withColumn("repaired", F.coalesce("b", "a")).withColumn(
        "state", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when((F.col("a") != F.col("b")) | (F.col("va") != F.col("vb")), "differs").otherwise("same"))


def content_hash(df: DataFrame, scale: int = 10_000) -> DataFrame:
    """Order-independent identity of a table: row count and the sum of the rows' md5 digests.

    Columns go in by name; fractions as whole multiples of 1/scale, so that every engine prints them
    alike, and NULL as an empty text.
    """
    def text(name: str, kind: str) -> Column:
        value = F.col(name)
        return F.coalesce((F.round(value * scale).cast("bigint") if kind in ("double", "float") else value).cast("string"), F.lit(""))

    kinds = dict(df.dtypes)
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[text(c, kinds[c]) for c in sorted(df.columns)])), 1, 12), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias("digest"))


def statuses(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fills, rejects and skips per key; a SKIPPED_ status is not a reject."""
    s = F.col("status")
    skip = s.startswith("SKIPPED_")
    return fills.groupBy(*by).agg(F.count(F.when(s == "FILLED", 1)).alias("filled"), F.count(F.when(skip, 1)).alias("skipped"),
                                  F.count(F.when((s != "FILLED") & ~skip, 1)).alias("rejected"))
