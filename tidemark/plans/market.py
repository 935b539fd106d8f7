"""The driver's tables read as market data, and the same mapping as SQL views.

ticks and fills come from `events`, long daily bars from `lineitem`, dated facts from `orders`,
headlines from `documents`. `symbol` is the user id in the tick tables; `market` is the event
type, a key with few values that each hold a fifth of the rows, and is the symbol of the
intraday bar tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import clock, costs
from tidemark.operators import bars, joins
from tidemark.plans.registry import view


class Market:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def ticks(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            ts.alias("ts"),
            F.col("user_id").cast("string").alias("symbol"),
            F.col("event_type").alias("market"),
            F.col("value").alias("px"),
            (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"),
            clock.session_date(ts).alias("session_date"),
            clock.minute_of_day(ts).alias("minute"),
        )

    def market_ticks(self) -> DataFrame:
        return self.ticks().drop("symbol").withColumnRenamed("market", "symbol")

    def bars(self, minutes: int = 5) -> DataFrame:
        return bars.stamp_session(bars.resample_ticks(self.market_ticks(), minutes * 60))

    def symbol_bars(self, minutes: int = 1) -> DataFrame:
        return bars.stamp_session(bars.resample_ticks(self.ticks(), minutes * 60))

    def daily(self) -> DataFrame:
        """Supplier-day bars. The price of a line is extended price per unit, in whole cents."""
        order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        lines = self.table("lineitem").withColumn("px", F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100)
        return lines.groupBy(
            F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date")
        ).agg(
            bars.first_by("px", *order).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            bars.last_by("px", *order).alias("close"),
            F.sum("l_quantity").cast("bigint").alias("volume"),
        )

    def quotes(self) -> DataFrame:
        """View and click events as top of book one percent around the value."""
        t = self.ticks().filter(F.col("market").isin("view", "click"))
        return t.select(
            "symbol", "ts", "seq", "session_date",
            (F.col("px") * 0.99).alias("bid"), (F.col("px") * 1.01).alias("ask"),
            F.col("size").alias("bid_sz"), (F.lit(101) - F.col("size")).alias("ask_sz"),
        )

    def fills(self) -> DataFrame:
        """Purchases buy and signups sell."""
        t = self.ticks().filter(F.col("market").isin("purchase", "signup"))
        return t.select(
            "symbol", "ts", "seq", "session_date", "minute",
            F.when(F.col("market") == "purchase", "BUY").otherwise("SELL").alias("side"),
            F.col("px").alias("price"), F.col("size").alias("qty"),
        )

    def status(self) -> DataFrame:
        """Error events halt a symbol; the next other event resumes it."""
        return self.ticks().select(
            "symbol", "ts", "seq", "session_date", "minute", (F.col("market") == "error").alias("halted")
        )

    def ledger(self) -> DataFrame:
        """Each purchase closed by the same symbol's next signup within ten days."""
        fills = self.fills()
        buys = fills.filter("side = 'BUY'").select(
            "symbol", "ts", "seq", "session_date", "minute", "price", "qty"
        )
        sells = fills.filter("side = 'SELL'").select(
            "symbol", "ts", "seq", F.col("ts").alias("exit_ts"), F.col("price").alias("exit_px"),
            F.col("minute").alias("exit_minute"), F.col("session_date").alias("exit_date"),
        )
        paired = joins.asof_join(
            buys, sells, ["symbol"], cols=["exit_ts", "exit_px", "exit_minute", "exit_date"],
            direction="forward", strict=True, tolerance_s=10 * 86400, bucket_s=10 * 86400,
        ).filter("exit_ts is not null")
        gross = (F.col("exit_px") - F.col("entry_px")) * F.col("qty")
        fee = costs.flat_commission(F.col("qty"))
        return paired.select(
            F.col("seq").alias("trade_id"), "symbol", "session_date",
            F.col("ts").alias("entry_ts"), "exit_ts",
            F.col("minute").alias("entry_minute"), "exit_minute", "exit_date",
            F.col("price").alias("entry_px"), "exit_px", "qty",
        ).withColumn("gross", gross).withColumn("commission", fee).withColumn(
            "net", F.col("gross") - F.col("commission")
        )

    def numbered_ledger(self) -> DataFrame:
        w = Window.partitionBy("symbol", "session_date").orderBy("entry_ts", "trade_id")
        return self.ledger().withColumn("ordinal", F.row_number().over(w))

    def facts(self) -> DataFrame:
        """Orders as facts filed on the order date about a period that ended 45 days before."""
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("symbol"),
            F.to_date("o_orderdate").alias("filed"),
            F.date_sub(F.to_date("o_orderdate"), 45).alias("period_end"),
            F.col("o_totalprice").alias("val"),
            F.col("o_orderkey").alias("row_id"),
        )

    def spells(self) -> DataFrame:
        """A customer is a member from one order to the next; the last spell is open."""
        w = Window.partitionBy("symbol").orderBy("start")
        days = self.facts().select("symbol", F.col("filed").alias("start")).distinct()
        return days.withColumn("end", F.lead("start").over(w))


view(
    "ticks",
    """SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS symbol, event_type AS market, value AS px,
         1 + CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS size,
         CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS session_date,
         CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') * 60
              + minute((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS INT) AS minute
       FROM events""",
)


def _bars_sql(key: str, minutes: int) -> str:
    return f"""SELECT *, CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS session_date,
         CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') * 60
              + minute((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS INT) AS minute
       FROM (SELECT {key} AS symbol, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts,
         first(px ORDER BY ts, seq) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS trades
       FROM ticks GROUP BY 1, 2)"""


view("bars5", _bars_sql("market", 5))
view("bars1", _bars_sql("market", 1))
view("sbars1", _bars_sql("symbol", 1))
view(
    "daily",
    """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
       FROM (SELECT *, floor(l_extendedprice / l_quantity * 100) / 100 AS px FROM lineitem) GROUP BY 1, 2""",
)
view(
    "quotes",
    """SELECT symbol, ts, seq, session_date, px * 0.99::DOUBLE AS bid, px * 1.01::DOUBLE AS ask, size AS bid_sz, 101 - size AS ask_sz
       FROM ticks WHERE market IN ('view', 'click')""",
)
view(
    "fills",
    """SELECT symbol, ts, seq, session_date, minute,
         CASE WHEN market = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, px AS price, size AS qty
       FROM ticks WHERE market IN ('purchase', 'signup')""",
)
view(
    "ledger",
    """SELECT *, gross - commission AS net FROM (
       SELECT b.seq AS trade_id, b.symbol, b.session_date, b.ts AS entry_ts, s.ts AS exit_ts,
         b.minute AS entry_minute, s.minute AS exit_minute, s.session_date AS exit_date,
         b.price AS entry_px, s.price AS exit_px, b.qty, (s.price - b.price) * b.qty AS gross,
         greatest(0.35::DOUBLE, 0.0035::DOUBLE * b.qty) * 2 AS commission
       FROM fills b JOIN fills s ON s.symbol = b.symbol AND s.side = 'SELL' AND s.ts > b.ts
         AND s.ts <= b.ts + INTERVAL 10 DAY
       WHERE b.side = 'BUY'
       QUALIFY row_number() OVER (PARTITION BY b.seq ORDER BY s.ts, s.seq) = 1)""",
)
view(
    "facts",
    """SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS filed,
         CAST(o_orderdate AS DATE) - 45 AS period_end, o_totalprice AS val, o_orderkey AS row_id FROM orders""",
)
view(
    "spells",
    """SELECT symbol, start, lead(start) OVER (PARTITION BY symbol ORDER BY start) AS "end"
       FROM (SELECT DISTINCT symbol, filed AS start FROM facts)""",
)
