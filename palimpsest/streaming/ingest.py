"""Structured Streaming over messages: fan-out into the memory tables, windows, bounded buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators.folded import Folded, sums
from ..operators.index import Index


def decorate(messages: DataFrame) -> DataFrame:
    """What ingestion derives from each message: decision, mood, memory type, drift. Works on streams and tables alike."""
    c = F.col("text")
    return messages.where("sender is not null").select("*", text.is_decision(c).alias("is_decision"), text.mood(c).alias("mood"), text.memory_type(c).alias("memory_type"), text.drift_score(c).alias("drift"))


def fan_out(stream: DataFrame, base: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes each micro-batch to four tables: messages, decisions, moods, memories.

    A batch's rows go to a folder of its id, which a repeated batch overwrites, so a restart after a
    failure leaves each message once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = decorate(batch).persist()
        try:
            _write(rows, batch.columns, batch_id)
        finally:
            rows.unpersist()

    def _write(rows: DataFrame, columns: list[str], batch_id: int) -> None:
        parts = {
            "messages": rows.select(*columns),
            "decisions": rows.where("is_decision").select("ts", F.substring("text", 1, 200).alias("decision"), "drift"),
            "moods": rows.where("mood <> ''").select("ts", "mood"),
            "memories": rows.select("ts", F.substring("text", 1, 300).alias("content"), F.col("memory_type").alias("type")),
        }
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def mood_windows(stream: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts of each mood in tumbling windows; rows later than ``late`` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "mood").agg(F.count("*").alias("n"))


BUFFER = "conv_id long, seq long, text string"


def evicting_buffer(stream: DataFrame, size: int = 5) -> DataFrame:
    """Each conversation's buffer of ``size`` messages (conv_id, seq, text); what falls out of it is emitted, oldest first.

    The state is the buffer, so it is bounded by ``size`` for each conversation.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        new = pd.concat(list(batches))
        held = sorted([*held, *zip(new["seq"].tolist(), new["text"].tolist(), strict=True)])
        out, held = held[:-size] if len(held) > size else [], held[-size:]
        state.update(([x[0] for x in held], [x[1] for x in held]))
        yield pd.DataFrame({"conv_id": [key[0]] * len(out), "seq": [x[0] for x in out], "text": [x[1] for x in out]})

    return stream.groupBy("conv_id").applyInPandasWithState(step, BUFFER, "seqs array<long>, texts array<string>", "append", GroupStateTimeout.NoTimeout)


def keep_index(stream: DataFrame, index: Index, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Brings the stored postings up to date with each micro-batch of (msg_id, text), in whatever order ids come; a batch that is repeated changes nothing."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: index.update(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replica(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A copy that only grows: each row of the stream, once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


PHANTOMS = "token string, born timestamp_ntz, last_seen timestamp_ntz, sightings long, first struct<msg_id:long,snippet:string>"


def _sightings(spark: SparkSession, path: str) -> Folded:
    return Folded(spark, path, PHANTOMS, sums("token", born="min", last_seen="max", sightings="sum", first="min"))


def keep_phantoms(stream: DataFrame, path: str, checkpoint: str, tokens=text.fts_tokens, once: bool = False) -> StreamingQuery:
    """Adds each micro-batch's sightings per token, as partial sums that are folded by levels; ``phantoms`` reads them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.select(F.col("msg_id").cast("long").alias("msg_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.substring("text", 1, 80).alias("snippet"), F.explode(tokens(F.col("text"))).alias("token"))
        rows = seen.select("token", F.col("ts").alias("born"), F.col("ts").alias("last_seen"), F.lit(1).cast("long").alias("sightings"), F.struct("msg_id", "snippet").alias("first"))
        _sightings(batch.sparkSession, path).add(rows, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def phantoms(spark: SparkSession, path: str) -> DataFrame:
    """(token, born, last_seen, sightings, snippet) over all batches so far; only the folders that are not folded yet are added up."""
    return _sightings(spark, path).read().select("token", "born", "last_seen", "sightings", F.col("first.snippet").alias("snippet"))


FIRED = "key string, n long, ts timestamp"


def counted_trigger(stream: DataFrame, every: int = 100, cool_down: str = "24 hours") -> DataFrame:
    """(key, n, ts) whenever a key's count of rows (key, ts) passes a multiple of ``every``, unless it fired within ``cool_down`` before.

    The state is two numbers a key. A micro-batch that passes several multiples fires once, for the last of them.
    """
    wait = pd.Timedelta(cool_down)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, fired = state.get if state.exists else (0, None)
        new = pd.concat(list(batches))
        latest, before = new["ts"].max(), n
        n += len(new)
        hit = n // every > before // every and (fired is None or latest >= pd.Timestamp(fired) + wait)
        state.update((n, latest.to_pydatetime() if hit else fired))
        rows = {"key": [key[0]], "n": [n // every * every], "ts": [latest]} if hit else {"key": [], "n": [], "ts": []}
        yield pd.DataFrame(rows).astype({"key": "object", "n": "int64", "ts": "datetime64[ns]"})

    return stream.groupBy("key").applyInPandasWithState(step, FIRED, "n long, fired timestamp", "append", GroupStateTimeout.NoTimeout)
