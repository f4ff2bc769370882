"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is two shuffles with partial aggregation; nothing is collected, and lineage is cut in the
shared folder. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each node's neighbours are linked to the least of them and the node itself.

    Joins are merged, not broadcast: a long chain of broadcasts would pile up in the driver.
    """
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m")).hint("merge")
    if large:
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionAll(least.select("u", F.col("_m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v): the least node of its component, as the root itself too.

    The steps keep components connected, so they are done once every component is one star: no node
    that points to another is pointed to.
    """
    now = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while now.select("v").join(now.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").limit(1).count() or now.groupBy("u").count().where("count > 1").limit(1).count():
        now = checkpoint(_star(_star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
