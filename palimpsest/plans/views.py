"""The memory tables as views over the driver's tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.index import FORMAT, Index
from ..sources.shared import shared_dir, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, conv_id, turn, ts, sender, text; the id follows from conversation and turn, so no order has to be computed.

    A turn has 20 bits of the id; one that doesn't fit is an error.
    """
    t = spread(read(spark, sf_dir, "conversations"))
    msg_id = F.when(F.col("turn").between(0, (1 << 20) - 1), F.shiftleft(F.col("conv_id").cast("long"), 20) + F.col("turn")).otherwise(F.raise_error(F.lit("a turn is out of range")).cast("long"))
    return t.select(
        msg_id.alias("msg_id"),
        "conv_id",
        "turn",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((conv_id * 1000 + turn) % 100000 as int))").alias("ts"),
        F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("sender"),
        "text",
    )


MESSAGES = """messages AS (
  SELECT conv_id::BIGINT * 1048576 + turn AS msg_id, conv_id, turn, TIMESTAMP '2024-01-01' + to_minutes(((conv_id * 1000 + turn) % 100000)::INT) AS ts,
         CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS sender, text FROM conversations)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("msg_id"), "text", "lang", "source")


def stored(spark: SparkSession, sf_dir: str) -> Index:
    """The stored postings of the corpus, in a folder named by the files they were made of; the first that asks has them built."""
    files = read(spark, sf_dir, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, mark = files.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*files.columns)), F.lit(0))).first()
    index = Index(spark, f"{shared_dir(spark)}/index-{FORMAT}-{n}-{mark & (1 << 64) - 1:016x}", text.words)
    if not index.segments():
        index.update(corpus(spark, sf_dir))
    return index


CORPUS = "corpus AS (SELECT doc_id AS msg_id, text, lang, source FROM documents)"


def moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events")
    return t.select("event_id", "user_id", "ts", F.expr("CASE event_type WHEN 'purchase' THEN 'happy' WHEN 'error' THEN 'anger' WHEN 'view' THEN 'confused' WHEN 'click' THEN 'surprised' ELSE 'anxious' END").alias("mood"), F.expr("CASE event_type WHEN 'purchase' THEN 1.0D WHEN 'error' THEN -1.0D WHEN 'view' THEN -0.3D WHEN 'click' THEN 0.3D ELSE -0.7D END").alias("valence"))


MOODS = """moods AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'happy' WHEN 'error' THEN 'anger' WHEN 'view' THEN 'confused' WHEN 'click' THEN 'surprised' ELSE 'anxious' END AS mood,
  CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN -1.0::DOUBLE WHEN 'view' THEN -0.3::DOUBLE WHEN 'click' THEN 0.3::DOUBLE ELSE -0.7::DOUBLE END AS valence FROM events)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, direction, drift, stage (ISO week), scene."""
    t = read(spark, sf_dir, "events")
    return t.select(
        "event_id",
        "user_id",
        "ts",
        F.expr("CASE event_type WHEN 'purchase' THEN 'spend' WHEN 'view' THEN 'frugal' WHEN 'error' THEN 'drift' ELSE 'neutral' END").alias("direction"),
        F.expr("CAST(bround(value) AS INT) * CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END").alias("drift"),
        F.expr("CAST(weekofyear(ts) AS INT)").alias("stage"),
        F.expr("concat('s', CAST(get_json_object(props, '$.k') AS INT) % 5)").alias("scene"),
    )


DECISIONS = """decisions AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'spend' WHEN 'view' THEN 'frugal' WHEN 'error' THEN 'drift' ELSE 'neutral' END AS direction,
  (round_even(value, 0)::INT * CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END)::INT AS drift, weekofyear(ts)::INT AS stage,
  's' || (json_extract_string(props, '$.k')::INT % 5) AS scene FROM events)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed memories: one for each embedding that has a document."""
    e, d = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "documents")
    i = F.col("vec_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("semantic", "episodic", "emotional", "procedural")]), (F.col("label") % 4 + 1).cast("int"))
    return e.join(d, e["vec_id"] == d["doc_id"]).select(
        i.alias("memory_id"),
        kind.alias("type"),
        F.col("text").alias("content"),
        (F.col("label") / 10.0).alias("arousal"),
        (1.0 / (1 + i % 5)).alias("weight"),
        (i % 7).cast("int").alias("access_count"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id as int))").alias("created_at"),
        (i % 11 == 0).alias("unresolved"),
        "embedding",
    )


MEMORIES = """memories AS (SELECT vec_id AS memory_id, ['semantic', 'episodic', 'emotional', 'procedural'][label % 4 + 1] AS type, text AS content,
  label / 10.0::DOUBLE AS arousal, 1.0::DOUBLE / (1 + vec_id % 5) AS weight, (vec_id % 7)::INT AS access_count, TIMESTAMP '2024-01-01' + to_hours(vec_id::INT) AS created_at,
  vec_id % 11 = 0 AS unresolved, embedding FROM embeddings JOIN documents ON vec_id = doc_id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as triples: customers and suppliers in nations, nations in regions, customers placing orders."""
    c, s, n, o = (read(spark, sf_dir, x) for x in ("customer", "supplier", "nation", "orders"))
    t = lambda df, a, r, b: df.select(F.expr(a).alias("subject"), F.lit(r).alias("relation"), F.expr(b).alias("object"))
    return t(c, "concat('c', c_custkey)", "in", "concat('n', c_nationkey)").unionAll(t(s, "concat('s', s_suppkey)", "in", "concat('n', s_nationkey)")).unionAll(t(n, "concat('n', n_nationkey)", "in", "concat('r', n_regionkey)")).unionAll(t(o, "concat('c', o_custkey)", "placed", "concat('o', o_orderkey)"))


EDGES = """edges AS (SELECT 'c' || c_custkey AS subject, 'in' AS relation, 'n' || c_nationkey AS object FROM customer UNION ALL SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || o_custkey, 'placed', 'o' || o_orderkey FROM orders)"""


def status_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object, ts, id): the status of a customer's orders over time."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.lit("status").alias("relation"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))


STATUS = "facts AS (SELECT o_custkey AS subject, 'status' AS relation, o_orderstatus AS object, o_orderdate AS ts, o_orderkey AS id FROM orders)"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("msg_id"), F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("helpful"))


FEEDBACK = "feedback AS (SELECT doc_id % 50 AS msg_id, doc_id AS seq, quality = 1 AS helpful FROM labels)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"
