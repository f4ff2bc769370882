"""Facts as triples: insertion, neighbourhoods, conflicts, validity intervals, contradictions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text

KEYS = ["subject", "relation", "object"]


def extract(docs: DataFrame, subject: str = "subject") -> DataFrame:
    """(msg_id, subject, relation, object) by the relation patterns, duplicates kept, blank entities dropped."""
    clean = text.clean_entity

    def one(pattern: str, relation: str):
        return F.transform(text.matches(F.col("text"), "(?U)" + pattern, 1), lambda x: F.struct(F.lit(subject).alias("subject"), F.lit(relation).alias("relation"), clean(x).alias("object")))

    def two(pattern: str, relation: str):
        a, b = (text.matches(F.col("text"), "(?U)" + pattern, g) for g in (1, 2))
        return F.zip_with(a, b, lambda x, y: F.struct(clean(x).alias("subject"), F.lit(relation).alias("relation"), clean(y).alias("object")))

    rows = [(one if re.compile(p).groups == 1 else two)(p, r) for p, r in lexicon.RELATIONS]
    return docs.select("msg_id", F.inline(F.flatten(F.array(*rows)))).where("subject is not null and object is not null")


def insert_absent(store: DataFrame, new: DataFrame) -> DataFrame:
    """Triples of ``new`` that the store lacks, once each."""
    return new.select(*KEYS).distinct().join(store.select(*KEYS), KEYS, "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("subject").alias("entity"), "relation", F.col("object").alias("other"), F.lit("out").alias("way"))
    return a.unionAll(edges.select(F.col("object").alias("entity"), "relation", F.col("subject").alias("other"), F.lit("in").alias("way")))


def neighbours(edges: DataFrame, entity: str, relation: str | None = None) -> DataFrame:
    out = undirected(edges).where(F.col("entity") == entity)
    return out.where(F.col("relation") == relation) if relation else out


def two_hops(edges: DataFrame, entity: str, most: int = 5) -> DataFrame:
    """(hop, via, relation, other): neighbours, and of each distinct one the ``most`` greatest edges."""
    both = undirected(edges)
    first = both.where(F.col("entity") == entity)
    near = first.select(F.col("other").alias("entity")).distinct()
    w = W.partitionBy("entity").orderBy(F.desc("relation"), F.desc("other"))
    second = both.join(near, "entity").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return first.select(F.lit(1).alias("hop"), "entity", "relation", "other").unionAll(second.select(F.lit(2), "entity", "relation", "other"))


def reach(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, distance) of what ``hops`` directed steps reach; each step joins the frontier only."""
    spark = edges.sparkSession
    step = edges.select(F.col("subject").alias("_s"), F.col("object").alias("_o")).distinct()
    seen = frontier = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("distance"))
    for k in range(1, hops + 1):
        frontier = step.join(frontier, step["_s"] == frontier["node"]).select(F.col("_o").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(k))
        seen = seen.unionAll(frontier)
    return seen


def stats(edges: DataFrame) -> DataFrame:
    """Triples by relation, with the number of entities of all."""
    n = edges.select(F.col("subject").alias("e")).unionAll(edges.select("object")).distinct().agg(F.count("*").alias("entities"))
    return edges.groupBy("relation").agg(F.count("*").alias("triples")).crossJoin(F.broadcast(n))


def summary(edges: DataFrame, most: int = 3) -> DataFrame:
    """For each entity and relation the first ``most`` targets in order, joined."""
    w = W.partitionBy("subject", "relation").orderBy("object")
    cut = edges.select(*KEYS).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return cut.groupBy("subject", "relation").agg(F.array_join(F.array_sort(F.collect_list("object")), ", ").alias("targets"))


def first_wins(facts: DataFrame) -> DataFrame:
    """Each fact against the first one of its (subject, relation): stored, confirmed or in conflict."""
    first = F.first("object").over(W.partitionBy("subject", "relation").orderBy("ts", "id"))
    rank = F.row_number().over(W.partitionBy("subject", "relation").orderBy("ts", "id"))
    return facts.withColumn("held", first).withColumn("verdict", F.when(rank == 1, "stored").when(F.col("object") == F.col("held"), "confirm").otherwise("conflict"))


def verdicts(known: DataFrame, claims: DataFrame) -> DataFrame:
    """Each claim against all known objects of its (subject, relation): confirm, conflict or unknown."""
    k = known.select("subject", "relation", F.col("object").alias("_o")).distinct()
    joined = claims.join(k, ["subject", "relation"], "left")
    return joined.groupBy(*KEYS).agg(F.max(F.when(F.col("_o") == F.col("object"), 1).otherwise(0)).alias("_same"), F.count("_o").alias("known")).select(
        *KEYS, F.when(F.col("_same") == 1, "confirm").when(F.col("known") > 0, "conflict").otherwise("unknown").alias("verdict"), "known"
    )


def intervals(facts: DataFrame) -> DataFrame:
    """Validity of a relation with one value at a time: repeats merge, a change closes what held."""
    w = W.partitionBy("subject", "relation").orderBy("ts", "id")
    changed = facts.withColumn("_b", F.lag("object").over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col("object")))
    return changed.select(*KEYS, F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_until"), "id")


def as_of(spans: DataFrame, moment: str) -> DataFrame:
    at = F.lit(moment).cast("timestamp_ntz")
    return spans.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def trace(log: DataFrame, roots: DataFrame, hops: int = 3) -> DataFrame:
    """Keyword chains from each root (word): from a root to the first message after the last one that holds it, whose longest new word is the next root."""
    ws = log.select("msg_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    now = roots.select(F.col("word").alias("root"), F.lit(0).alias("hop"), "word", F.lit(0).cast("long").alias("msg_id"))
    out = now
    for k in range(1, hops + 1):
        hit = now.alias("n").join(ws.alias("w"), "word").where("w.msg_id > n.msg_id").groupBy("root").agg(F.min("w.msg_id").alias("msg_id"))
        used = out.select("root", "word")
        nxt = hit.join(ws, "msg_id").join(used, ["root", "word"], "left_anti").groupBy("root", "msg_id").agg(F.max(F.struct(F.length("word").alias("l"), "word"))["word"].alias("word"))
        now = nxt.select("root", F.lit(k).alias("hop"), "word", "msg_id")
        out = out.unionAll(now)
    return out
