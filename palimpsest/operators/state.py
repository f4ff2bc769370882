"""Small state derived from append-only tables: tasks, rules, marks, stages, charts, metrics, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def task_id(task: Column, trigger: Column) -> Column:
    return F.substring(F.md5(F.concat(task, trigger)), 1, 8)


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an append-only log read as current state."""
    return events.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(o) for o in order]))).where("_r = 1").drop("_r")


def rank_rules(rules: DataFrame, uses: DataFrame, most: int = 5) -> DataFrame:
    """Rules (pos, rule) by how often they were used (rule), most used first, then in their order."""
    counts = uses.groupBy("rule").agg(F.count("*").alias("uses"))
    return rules.join(counts, "rule", "left").withColumn("uses", F.coalesce("uses", F.lit(0))).orderBy(F.desc("uses"), "pos").limit(most)


def chart(value: Column, unit: float = 10.0, most: int = 40) -> Column:
    """A bar for a figure's size, with its sign before it."""
    n = F.least(F.lit(most), F.floor(F.abs(value) / unit)).cast("int")
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.repeat(F.lit("█"), n))


def stages(decisions: DataFrame) -> DataFrame:
    """Stages in the order they were first seen, with their extent."""
    return decisions.groupBy("stage").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def acceleration(rows: DataFrame, key: str, order: list[str], value: str, short: int = 5, long: int = 15) -> DataFrame:
    """Mean of the last ``short`` values of each key and of the ``long`` before them, and whether the figure speeds up."""
    w = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    r = rows.withColumn("_r", F.row_number().over(w))
    g = r.groupBy(key).agg(F.round(F.avg(F.when(F.col("_r") <= short, F.col(value))), 6).alias("recent"), F.round(F.avg(F.when((F.col("_r") > short) & (F.col("_r") <= short + long), F.col(value))), 6).alias("earlier"))
    return g.withColumn("speeds_up", F.coalesce(F.abs("recent") > F.abs("earlier"), F.lit(False)))


def annotate_due(log: DataFrame, every: int = 100) -> DataFrame:
    """Messages of each conversation at which a count of ``every`` is full."""
    r = log.withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("msg_id")))
    return r.where(F.col("n") % every == 0)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, and rows with a null, of each table; one pass over each."""
    out = None
    for name, df in tables.items():
        broken = None
        for c in df.columns:
            broken = F.col(c).isNull() if broken is None else broken | F.col(c).isNull()
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.count_if(broken).alias("with_nulls"))
        out = one if out is None else out.unionAll(one)
    return out
