"""Timers as rows: a base row with a name and a time, joined to a clock or to the messages that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start_timers(rows: DataFrame, sid: str, ts: str, name: str, seconds: int) -> DataFrame:
    """One-shot timers that start at each row: (sid, timer_name, started, base_time)."""
    started = F.col(ts).cast("timestamp")
    return rows.select(F.col(sid).alias("sid"), F.lit(name).alias("timer_name"), started.alias("started"), (started + F.make_dt_interval(secs=F.lit(seconds))).alias("base_time"))


def restarted(timers: DataFrame) -> DataFrame:
    """Of the timers of one name in a context only the last start counts: starting one again cancels it."""
    return timers.groupBy("sid", "timer_name").agg(F.max_by(F.struct("started", "base_time"), "started").alias("t")).select("sid", "timer_name", "t.*")


def cancelled(timers: DataFrame, cancels: DataFrame) -> DataFrame:
    """Timers without those that a row (sid, timer_name, ts) cancels before their time."""
    c = cancels.select(F.col("sid").alias("_sid"), F.col("timer_name").alias("_name"), F.col("ts").cast("timestamp").alias("_ts"))
    return timers.join(c, (F.col("sid") == F.col("_sid")) & (F.col("timer_name") == F.col("_name")) & (F.col("_ts") >= F.col("started")) & (F.col("_ts") < F.col("base_time")), "left_anti")


def expired(timers: DataFrame, now: Column) -> DataFrame:
    """Timers whose time has come on this clock."""
    return timers.where(F.col("base_time") <= now)


def unanswered(timers: DataFrame, answers: DataFrame, sid: str, ts: str) -> DataFrame:
    """Timers that run out with no answering row of their context after the start and up to their time."""
    a = answers.select(F.col(sid).alias("_sid"), F.col(ts).cast("timestamp").alias("_ts"))
    return timers.join(a, (F.col("sid") == F.col("_sid")) & (F.col("_ts") > F.col("started")) & (F.col("_ts") <= F.col("base_time")), "left_anti")


def velocity(rows: DataFrame, sid: str, ts: str, length: str) -> DataFrame:
    """Rows of each context in tumbling windows: (sid, start, n)."""
    return rows.groupBy(F.col(sid).alias("sid"), F.window(F.col(ts).cast("timestamp"), length)).agg(F.count("*").alias("n")).select("sid", F.col("window.start").alias("start"), "n")
