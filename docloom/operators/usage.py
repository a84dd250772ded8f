"""Usage analytics over request logs (A01-A07, F12, O05-O07, W15-W16, ST03, ST08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(log: DataFrame, tokens: Column, latencies: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Requests, total tokens and mean latencies; zeros for an empty log."""
    rows = log.filter(where) if where is not None else log
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{name}") for name, c in latencies.items()]
    return rows.agg(F.count("*").alias("total_requests"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"), *means)


def daily(log: DataFrame, user: str, at: str, amount: Column) -> DataFrame:
    """Amount used per user and day."""
    return log.groupBy(F.col(user).alias("user_id"), F.to_date(at).alias("day")).agg(F.sum(amount).alias("used"))


def add_usage(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Old daily amounts with new ones added; what an upsert would leave."""
    return old.select("user_id", "day", "used").unionByName(delta.select("user_id", "day", "used")).groupBy("user_id", "day").agg(F.sum("used").alias("used"))


def used_on(usage: DataFrame, user: object, day: Column) -> DataFrame:
    """One row with the amount, 0 if there is none."""
    return usage.filter((F.col("user_id") == user) & (F.col("day") == day)).agg(F.coalesce(F.sum("used"), F.lit(0)).alias("used"))


def monthly(usage: DataFrame) -> DataFrame:
    """Amounts by month."""
    return usage.groupBy("user_id", F.trunc("day", "month").alias("month")).agg(F.sum("used").alias("used"))


def newest(log: DataFrame, at: str, key: str, limit: int = 100, where: Column | None = None) -> DataFrame:
    """The newest rows."""
    return (log.filter(where) if where is not None else log).orderBy(F.desc(at), F.desc(key)).limit(limit)


def page(rows: DataFrame, order: list[Column], skip: int = 0, take: int = 50) -> DataFrame:
    """O06"""
    return rows.orderBy(*order).offset(skip).limit(take)


def trailing_count(log: DataFrame, keys: list[str], at: str, seconds: int = 60) -> DataFrame:
    """Requests of a key within the last seconds, this one included."""
    span = Window.partitionBy(*keys).orderBy(F.unix_micros(F.to_timestamp(F.col(at)))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return log.withColumn("recent", F.count("*").over(span))


def stage_times(log: DataFrame, total: str, known: list[str]) -> DataFrame:
    """ST08: what is left of the total after the known stages, never below 0."""
    spent = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in known), F.lit(0.0))
    return log.withColumn("other", F.greatest(F.lit(0.0), F.col(total) - spent))


def health(states: DataFrame) -> DataFrame:
    """Ok if all parts are, error if any is in error, else degraded."""
    return states.agg(F.when(F.every(F.col("state") == "ok"), "ok").when(F.some(F.col("state") == "error"), "error").otherwise("degraded").alias("status"))


def connections(registry: DataFrame) -> DataFrame:
    """Connections and distinct users."""
    return registry.agg(F.count("*").alias("connections"), F.count_distinct("user_id").alias("users"))


def storage(files: DataFrame) -> DataFrame:
    """Files and their size in MB, from rows with `length` (as the binaryFile source gives)."""
    return files.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 2).alias("total_mb"))
