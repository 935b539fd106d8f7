"""Incremental forward scoring: completed sessions are scored once, and a changed history is refused.

A log holds a fingerprint of each session as it was when it was scored: the number of its rows and the
sum of their hashes, which no order of rows changes. A run compares the history with the log before it
scores anything, scores the sessions the log lacks (the newest one is not complete), and logs them last,
so a run that was cut short is repeated to the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class ChangedHistory(ValueError):
    """Sessions that were scored have other rows now, or none."""


def fingerprints(history: DataFrame, date: str) -> DataFrame:
    row = F.xxhash64(*sorted(history.columns)).cast("decimal(38,0)")
    return history.groupBy(date).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string")).alias("fingerprint"))


def held(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing path means that nothing was scored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def score_new(history: DataFrame, score: Callable[[DataFrame], DataFrame], root: str, date: str = "session_date") -> int:
    """Score the completed sessions of history that were not scored before; returns how many.

    root/scores has one partition a session, root/log one row a session (with the run that scored it).
    """
    spark = history.sparkSession
    now = fingerprints(history, date)
    log = held(spark, f"{root}/log")
    run = 1
    if log is not None:
        then = log.select(date, F.col("fingerprint").alias("logged"))
        changed = then.join(now, date, "left").filter(~F.col("logged").eqNullSafe(F.col("fingerprint")))
        found = changed.orderBy(date).limit(10).collect()
        if found:
            raise ChangedHistory(", ".join(f"{r[date]}: {r.logged} scored, {r.fingerprint} now" for r in found))
        run = log.agg(F.max("run")).first()[0] + 1
    newest = now.agg(F.max(date)).first()[0]
    fresh = now.filter(F.col(date) < F.lit(newest))
    if log is not None:
        fresh = fresh.join(log.select(date), date, "left_anti")
    staged = f"{root}/staged/run={run}"
    fresh.write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(fresh.schema).parquet(staged)
    sessions = fresh.count()
    if sessions:
        rows = history.join(fresh.select(date), date, "left_semi")
        score(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(f"{root}/scores")
        fresh.write.mode("overwrite").parquet(f"{root}/log/run={run}")
    return sessions


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], root: str, date: str = "session_date") -> StreamingQuery:
    """Each batch joins the history and its completed sessions are scored; a batch that is replayed replaces itself."""

    def land(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/history/epoch={epoch}")
        score_new(df.sparkSession.read.parquet(f"{root}/history").drop("epoch"), score, root, date)

    return stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(land).start()


def early_stop(scores: DataFrame, max_loss: float, min_sessions: int, date: str = "session_date") -> DataFrame:
    """One row: whether the forward run has lost too much to go on."""
    return scores.agg(F.count_distinct(date).alias("sessions"), F.sum("net").alias("net")).withColumn(
        "stopped", (F.col("sessions") >= min_sessions) & (F.col("net") <= -max_loss))
