"""The table of registered queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}
VIEWS: dict[str, str] = {}
DIGITS: dict[str, int] = {}
# Moves exact decimal ties off the rounding edge, where two engines' round() may differ.
TIE_SHIFT = 2.37e-3

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def printable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Types both engines print alike: text dates and stamps, rounded doubles, wide integers."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + TIE_SHIFT * 10.0**-digits, digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("int").cast("bigint") if isinstance(field.dataType, T.BooleanType) else c.cast("bigint")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def view(name: str, sql: str) -> None:
    """A named subquery other oracle texts may use."""
    VIEWS[name] = sql


def _expand_macro(sql: str, tag: str, before: str, after: str) -> str:
    while True:
        at = sql.find(tag + "(")
        if at < 0:
            return sql
        depth, i = 0, at + len(tag)
        while True:
            if sql[i] == "(":
                depth += 1
            elif sql[i] == ")":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        inner = sql[at + len(tag) + 1 : i]
        sql = sql[:at] + before + inner + after + sql[i + 1 :]


def full_sql(sql: str, digits: int = 6) -> str:
    """Prepend the named subqueries a text uses and expand the printing macros."""
    wanted: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                wanted.append(name)

    visit(sql)
    if wanted:
        head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
        body = sql.strip()
        if body.upper().startswith("WITH RECURSIVE"):
            sql = f"WITH RECURSIVE {head},\n{body[14:]}"
        elif body.upper().startswith("WITH"):
            sql = f"WITH RECURSIVE {head},\n{body[4:]}"
        else:
            sql = f"WITH RECURSIVE {head}\n{body}"
    sql = _expand_macro(sql, "@R", "round(CAST(", f" AS DOUBLE) + 2.37e-{digits + 3}, {digits})")
    sql = _expand_macro(sql, "@T", "strftime(", ", '%Y-%m-%d %H:%M:%S')")
    sql = _expand_macro(sql, "@D", "strftime(", ", '%Y-%m-%d')")
    sql = _expand_macro(sql, "@I", "CAST(", " AS BIGINT)")
    return sql


def query(name: str, covers: str, sql: str | None = None, digits: int = 6):
    """Register fn(market) -> DataFrame under `name`, with its oracle text."""
    from tidemark.plans.market import Market

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return printable(fn(Market(spark, folder)), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
            DIGITS[name] = digits
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    return {name: full_sql(sql, DIGITS[name]) for name, sql in ORACLE.items()}
