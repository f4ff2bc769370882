"""The message log: scans, filters, tiering, merging and derived indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text


def recent(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages in ascending order; a distributed top-n."""
    return log.orderBy(F.desc("msg_id")).limit(max(n, 0)).orderBy("msg_id")


def substring_scan(log: DataFrame, needle: str, limit: int | None = None, month: str | None = None) -> DataFrame:
    """Messages whose text holds ``needle``, ignoring case, in log order."""
    out = log.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    if month:
        out = out.where(F.date_format("ts", "yyyy-MM") == month)
    return out.orderBy("msg_id").limit(limit) if limit else out


def valued(log: DataFrame, least: float = 0.3) -> DataFrame:
    """Messages with their information value; an agent's below ``least`` go."""
    out = log.withColumn("info_value", text.info_value(F.col("text")))
    return out.where((F.col("sender") != "agent") | (F.col("info_value") >= least))


def fate(log: DataFrame, now: str, days: int = 30, keep_pattern: str = lexicon.KEEP_ARCHIVED) -> DataFrame:
    """``fate`` of each message when the log is tiered: kept while young, else moved, or dropped if an agent said little."""
    old = F.datediff(F.lit(now).cast("date"), F.col("ts").cast("date")) > days
    little = (F.col("sender") == "agent") & (F.length("text") < 100) & ~F.col("text").rlike(keep_pattern)
    return log.withColumn("fate", F.when(~old, "kept").when(little, "dropped").otherwise("moved")).withColumn("month", F.date_format("ts", "yyyy-MM"))


def archive_stats(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def merge_new(log: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` that are not in ``log`` by ``keys``, one for each key."""
    return incoming.join(log.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def role_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("sender").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def timeline(log: DataFrame, period: Column) -> DataFrame:
    """Messages of each period: number, and the texts of the first and last."""
    return log.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.min_by("text", "msg_id").alias("first_text"), F.max_by("text", "msg_id").alias("last_text"))


def consecutive_distinct(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the one before them under the same key."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def buffer(log: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The last ``n`` messages under each key: what a bounded buffer holds after all arrived."""
    w = W.partitionBy(key).orderBy(F.desc("msg_id"))
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
