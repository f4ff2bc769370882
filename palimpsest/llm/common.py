"""Query plumbing of the subpackage: reading tables and joining small group tables of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group table (sources, language and source pairs) is broadcast up to this many rows; above, Spark joins it by shuffle.
BROADCAST_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: lambda bodies would otherwise evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on null-safe ``keys`` with a table of one row per group; broadcast only if counted to be small."""
    small = groups.count() <= most
    g = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        on = same if on is None else on & same
    return rows.join(F.broadcast(g) if small else g, on, "left").drop(*[f"_g_{k}" for k in keys])
