"""Readers and writers of message logs: text lines, chat exports, JSON lines, month-partitioned archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = "yyyy-MM-dd HH:mm:ss"
CHAT = T.StructType([T.StructField("create_time", T.DoubleType()), T.StructField("message", T.StructType([T.StructField("author", T.StructType([T.StructField("role", T.StringType())])), T.StructField("content", T.StructType([T.StructField("parts", T.ArrayType(T.StringType()))]))]))])
MAPPING = T.StructType([T.StructField("mapping", T.MapType(T.StringType(), CHAT))])
CHAT_MESSAGES = T.StructType([T.StructField("chat_messages", T.ArrayType(T.StructType([T.StructField("sender", T.StringType()), T.StructField("text", T.StringType())])))])
DECISIONS = T.StructType(
    [T.StructField("ts", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("direction", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("scenes", T.ArrayType(T.StringType())), T.StructField("_corrupt_record", T.StringType())]
)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``ts | sender | text`` lines (column ``value``) to columns; malformed ones are told by ``valid``."""
    parts = F.split("value", r" \| ", 3)
    return lines.select("*", (F.size(parts) == 3).alias("valid"), F.get(parts, F.lit(0)).alias("_ts"), F.get(parts, F.lit(1)).alias("sender"), F.get(parts, F.lit(2)).alias("text")).withColumn("ts", F.try_to_timestamp("_ts", F.lit(TS)).cast("timestamp_ntz")).drop("_ts")


def log_text(spark: SparkSession, path: str) -> DataFrame:
    """Valid messages of a text log."""
    return parse_lines(spark.read.text(path)).where("valid").select("ts", "sender", "text")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path)).where("not valid").select("value")


def _sender(role):
    return F.when(role.isin("user", "human"), "user").otherwise("agent")


def chat_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Exports whose ``mapping`` holds nodes with a message each, in order of their time; parts that aren't text go."""
    raw = spark.read.schema(MAPPING).option("multiLine", True).json(path)
    node = raw.select(F.explode(F.map_values("mapping")).alias("n")).where("n.message is not null")
    # a part that is an object or an array reads as JSON text
    parts = F.filter("n.message.content.parts", lambda x: x.isNotNull() & ~x.rlike(r"^[\[{]"))
    return node.select(F.col("n.create_time").alias("created"), _sender(F.col("n.message.author.role")).alias("sender"), F.array_join(parts, "").alias("text")).where("text <> ''").orderBy("created")


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Exports with a list of ``chat_messages``; ``pos`` keeps their order."""
    raw = spark.read.schema(CHAT_MESSAGES).option("multiLine", True).json(path)
    return raw.select(F.posexplode("chat_messages").alias("pos", "m")).select("pos", _sender(F.col("m.sender")).alias("sender"), F.col("m.text").alias("text")).where("text <> ''")


def plain(spark: SparkSession, path: str) -> DataFrame:
    """Each line that isn't blank is a message of the user."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.lit("user").alias("sender"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType = DECISIONS) -> DataFrame:
    """JSON lines; those that don't parse are dropped."""
    raw = spark.read.schema(schema).json(path)
    return raw.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in schema.names else raw


READERS = {"log": log_text, "chatgpt": chat_mapping, "claude": chat_messages, "plain": plain}


def read_any(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(READERS)}")
    return READERS[kind](spark, path)


def export_text(log: DataFrame, path: str, month: str | None = None) -> None:
    """Writes messages as text lines, optionally of one month."""
    rows = log.where(F.date_format("ts", "yyyy-MM") == month) if month else log
    rows.select(F.concat_ws(" | ", F.date_format("ts", TS), "sender", "text").alias("value")).write.text(path)


def write_archive(fates: DataFrame, path: str) -> None:
    """Moved messages (see ``operators.log.fate``), partitioned by month so that searches prune."""
    fates.where("fate = 'moved'").drop("fate").write.partitionBy("month").mode("append").parquet(path)


def search_archive(spark: SparkSession, path: str, needle: str, month: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("month") == month) if month else rows
    whole = F.concat_ws(" | ", F.date_format("ts", TS), "sender", "text")
    return rows.where(F.contains(F.lower(whole), F.lit(needle.lower()))).select("month", "ts", "sender", F.left("text", F.lit(300)).alias("text"))
