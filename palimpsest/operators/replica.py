"""Comparison of two copies of a table by digests that merge.

A row's digest is two 64-bit hashes of its columns; the digest of a set of rows is their number and the sums of
these hashes, whatever their order. Sets are leaves (month, bucket of the id), leaves add up to months and
months to the table, so digests of batches can be stored and added. Two copies are compared from the top:
only leaves of months that differ are looked at, and only rows of leaves that differ are brought together.
Each copy is read where it lies and reduced in its tasks; what is shuffled is a row for each leaf, and then
the rows of the leaves that differ.

Defined cases: nulls in any column, and a null id or month, are values like others; repeated rows count as often
as they occur; columns are compared by the names given; an empty copy lacks every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Leaves up to which their list is sent to all tasks.
SENT_LEAVES = 500_000
#: Fewer rows than this many below the largest number seen are no alarm.
SHRINK = 10
_DIGEST = ["n", "s1", "s2"]


def _hashes(columns: list[str]) -> list[Column]:
    # a null leaves a hash as it is, so it is told by its place
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)]


def _leaf(rows: DataFrame, key: str, month: Column, columns: list[str]) -> DataFrame:
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    return rows.select(*columns, month.alias("_month"), bucket.alias("_bucket"), *_hashes(columns))


def digest(rows: DataFrame, key: str, month: Column, columns: list[str] | None = None) -> DataFrame:
    """(month, bucket, n, s1, s2) of the leaves of a table; a row for each leaf."""
    leaves = _leaf(rows, key, month, columns or rows.columns)
    sums = [F.sum(F.col(f"h{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    return leaves.groupBy(F.col("_month").alias("month"), F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"), *sums)


def merged(*digests: DataFrame) -> DataFrame:
    """The digest of all rows of several tables, from theirs."""
    return reduce(DataFrame.unionByName, digests).groupBy("month", "bucket").agg(*[F.sum(c).alias(c) for c in _DIGEST])


def _apart(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose sums differ."""
    total = lambda df: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _DIGEST])
    signed = total(a).unionByName(total(b).select(*keys, *[(-F.col(c)).alias(c) for c in _DIGEST]))
    differ = reduce(lambda x, y: x | y, [F.col(c) != 0 for c in _DIGEST])
    return signed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _DIGEST]).where(differ).select(*keys)


def leaves_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """(month, bucket) of the leaves in which two digests differ, by way of their months."""
    months = _apart(a, b, ["month"]).withColumnRenamed("month", "_m")
    within = lambda df: df.join(F.broadcast(months), F.col("month").eqNullSafe(F.col("_m")), "left_semi")  # noqa: E731  a row a month
    return _apart(within(a), within(b), ["month", "bucket"])


def _met(leaves: DataFrame, apart: DataFrame, n: int, kind: str = "left_semi") -> DataFrame:
    named = apart.withColumnsRenamed({"month": "_m", "bucket": "_b"})
    on = (F.col("_bucket") == F.col("_b")) & F.col("_month").eqNullSafe(F.col("_m"))
    return leaves.join(F.broadcast(named) if n <= SENT_LEAVES else named, on, kind)


def differences(primary: DataFrame, copy: DataFrame, key: str, month: Column, columns: list[str] | None = None, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, status): ids whose rows ``copy`` lacks (missing), has besides (added), or has otherwise (changed).

    ``digests`` are those of the two, if they are stored; else each is worked out in one pass.
    """
    from ..sources.shared import checkpoint

    names = columns or primary.columns
    a, b = digests or (digest(primary, key, month, names), digest(copy, key, month, names))
    apart = checkpoint(leaves_apart(a, b))
    n = apart.count()
    rows = [_met(_leaf(df, key, month, names), apart, n).select(F.col(key), "h1", "h2", F.lit(sign).alias("k")) for df, sign in ((primary, 1), (copy, -1))]
    odd = rows[0].unionByName(rows[1]).groupBy(key, "h1", "h2").agg(F.sum("k").alias("k")).where("k <> 0")
    status = F.when(F.max("k") < 0, "added").when(F.min("k") > 0, "missing").otherwise("changed")
    # an id with some rows too many or too few beside equal ones has changed only if both copies hold it otherwise
    return odd.groupBy(key).agg(status.alias("status"))


def repaired(primary: DataFrame, copy: DataFrame, key: str, month: Column, columns: list[str] | None = None) -> DataFrame:
    """The copy with the leaves that differ taken from the primary; the others are not read from it."""
    from ..sources.shared import checkpoint

    names = columns or primary.columns
    apart = checkpoint(leaves_apart(digest(primary, key, month, names), digest(copy, key, month, names)))
    n = apart.count()
    good, new = (_met(_leaf(df, key, month, names), apart, n, kind) for df, kind in ((copy, "left_anti"), (primary, "left_semi")))
    return good.select(*names).unionByName(new.select(*names))


def shrunk(counts: dict[str, int], seen: dict[str, int], most: int = SHRINK) -> dict[str, int]:
    """By how many rows each table has shrunk below the largest number seen, where that is more than ``most``."""
    return {name: seen[name] - n for name, n in counts.items() if name in seen and seen[name] - n > most}
