"""Many moments against many intervals, by equality on hierarchical bins.

Time is cut into bins of 1, 2, 4, ... units. An interval is the union of at most two bins of each size, and so
of at most 2 log n bins that don't overlap; a moment lies in one bin of each size. So a moment is in an
interval exactly if they share a bin, and they share one at most: an equi-join on (key, size, bin) finds
each pair once, without a range predicate, and no interval is copied to all the bins it spans.

Intervals are [start, end), in whole units (days, seconds, microseconds); a null end is open.

Defined cases: a null start or key, or an end not after the start, is in no bin; a null moment or key is in none;
repeated rows are joined each; columns of the two sides other than the key mustn't share names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint


def _bins(start: Column, end: Column, sizes: int) -> Column:
    """The bins (level, bin) whose union is [start, end), of numbers from 0."""
    low = lambda level: F.ceil(start / F.pow(F.lit(2.0), level)).cast("long")  # noqa: E731  exact below 2^53
    high = lambda level: F.floor(end / F.pow(F.lit(2.0), level)).cast("long")

    def at(level: Column) -> Column:
        one = lambda bin_: F.struct(level.cast("int").alias("level"), bin_.alias("bin"))
        s, e = low(level), high(level)
        none = F.array().cast("array<struct<level:int,bin:bigint>>")
        left = F.when((s < e) & (s % 2 == 1), F.array(one(s))).otherwise(none)
        right = F.when((s < e) & (e % 2 == 1), F.array(one(e - 1))).otherwise(none)
        return F.concat(left, right)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(sizes)), at))


#: Intervals of a key up to which each is compared with all its key's moments.
FEW = 64
#: Keys of more intervals up to which they are sent to all tasks.
SENT_KEYS = 100_000
#: Units that are tried, the largest first: a day, an hour, a minute, a second, a millisecond in microseconds, and one.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def as_of_many(moments: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, units: tuple[int, ...] = UNITS) -> DataFrame:
    """Each row of ``moments`` with each row of ``intervals`` of its key that holds at ``at``.

    Keys of at most ``FEW`` intervals are joined by the key alone: a moment goes there once, without bins. The others go by bins,
    of which the largest of ``units`` that divides all their bounds is the smallest size: only bounds need it to be exact.
    """
    held = checkpoint(intervals.where(F.col(start).isNotNull() & F.col(key).isNotNull() & F.coalesce(F.col(end) > F.col(start), F.lit(True))))
    many = checkpoint(held.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(key))
    n = many.count()
    within = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    if not n:
        return moments.join(held, key).where(within)
    some = F.broadcast(many) if n <= SENT_KEYS else many
    few = moments.join(held.join(some, key, "left_anti"), key).where(within)
    return few.unionAll(_by_bins(moments.join(some, key, "left_semi"), held.join(some, key, "left_semi"), key, at, start, end, units).select(few.columns))


def _by_bins(moments: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, units: tuple[int, ...]) -> DataFrame:
    even = [F.coalesce(F.bool_and((F.col(start) % u == 0) & (F.coalesce(F.col(end), F.lit(0)) % u == 0)), F.lit(True)).alias(f"u{u}") for u in units]
    facts = intervals.agg(F.min(start).alias("low"), F.greatest(F.max(start), F.coalesce(F.max(end), F.max(start))).alias("high"), *even).first()
    unit = next((u for u in units if facts[f"u{u}"]), 1)
    low, top = facts["low"], facts["high"] // unit * unit + unit  # beyond every bound: what is later is in the open intervals as top - 1 is
    sizes = ((top - low) // unit).bit_length()
    if sizes > 52:
        raise ValueError("the times span more than 2^52 units; take larger ones")
    until = F.coalesce(end, F.lit(top))
    binned = intervals.withColumns({"_s": F.col(start) - low, "_e": until - low})
    binned = binned.withColumn("_b", F.explode(_bins(F.expr(f"_s div {unit}"), F.expr(f"_e div {unit}"), sizes))).drop("_s", "_e")
    used = [r["level"] for r in binned.select(F.col("_b.level").alias("level")).distinct().collect()]  # at most 53
    bins = F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright("_t", x).alias("bin")) for x in sorted(used)]) if used else F.array().cast("array<struct<level:int,bin:bigint>>")
    asked = moments.where(F.col(at) >= low).withColumn("_t", F.least(F.col(at).cast("long"), F.lit(top - 1)) - low).withColumn("_t", F.expr(f"_t div {unit}")).withColumn("_b", F.explode(bins)).drop("_t")
    flat = lambda df: df.withColumns({"_level": F.col("_b.level"), "_bin": F.col("_b.bin")}).drop("_b")
    return flat(asked).join(flat(binned), [key, "_level", "_bin"]).drop("_level", "_bin")
