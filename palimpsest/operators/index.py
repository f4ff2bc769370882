"""Stored postings of a growing log: segments of token-sorted blocks, named by a log of commits.

A batch of messages becomes a segment. Its messages are dealt to blocks of similar length (at most about
``BLOCK_DOCS`` messages and ``BLOCK_POSTINGS`` postings); a row of ``postings`` is one token in one block: the
ids and lengths of the messages that hold it, as the bytes of two arrays, and the least length, which bounds what
any of them can score. Rows are sorted by token over the files, so a search reads the row groups of its tokens.
A segment also keeps each message's tokens, for norms and merges.

Which messages are new is told by an anti-join with the ids that the live segments hold, of those whose
range of ids meets the batch's: batches may come late, in any order, or again. A segment counts once a
commit names it, and a commit is atomic, so an update that failed half-way leaves nothing behind that
a reader could see, and two writers can't both index a message. Deletions are ids with the number
of their commit; they hide what was indexed before. ``FANOUT`` segments of a level are merged to one of the
next, without what was deleted: the number of segments follows the logarithm of the batches.

``norms`` adds, once for each commit, what cosine search needs of all messages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.commits import Commits
from ..sources.shared import checkpoint

BLOCK_DOCS, BLOCK_POSTINGS = 2048, 1 << 20
FANOUT = 4
#: Of the files and commits; part of the name of folders that outlive a session.
FORMAT = 3
POSTINGS = "token string, block long, n long, least int, ids binary, lengths binary"
BLOCKS = "token string, block long, n long, least int, ids array<long>, lengths array<int>"
LENGTHS = "msg_id long, dl long, block long"
TOKENS = "msg_id long, seq long, dl long, tokens array<string>"
NORMS = "block long, least double, ids binary, norms binary"
#: Tokens up to which a search names them to the scan, so that row groups are skipped by their statistics.
NAMED = 2000
#: Postings (some 20 bytes each) of a task that sorts them, whatever the session's number of partitions.
PART_POSTINGS = 4 << 20
#: Bytes of a row group of postings: what a search skips or reads.
ROW_GROUP = 16 << 20
#: Deleted ids up to which they are sent to all tasks.
SENT_IDS = 1_000_000
#: Messages from which a token's weight may be sent to all tasks; more are asked for where that leaves over ``SENT_IDS`` tokens.
FREQUENT = 64


def _band(dl: Column) -> Column:
    """Classes of similar length: eight to a doubling."""
    octave = F.floor(F.log2(dl.cast("double")))
    return F.when(dl < 8, dl).otherwise(octave * 8 + F.floor(dl / F.pow(F.lit(2.0), octave) * 8) - 8).cast("long")


def packed(cuts: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """Parts of an array, from cut to cut, as their bytes."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def flat(column: pa.ChunkedArray | pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column that was packed, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    cuts = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]] if cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(cuts).astype(np.int64) // np.dtype(kind).itemsize


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``POSTINGS`` as rows of ``BLOCKS``."""
    for batch in batches:
        ids, size = flat(batch.column("ids"), np.int64)
        lengths, _ = flat(batch.column("lengths"), np.int32)
        cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        held = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (ids, lengths)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("token", "block", "n", "least")] + held, ["token", "block", "n", "least", "ids", "lengths"])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCKS`` as rows of ``POSTINGS``."""
    for batch in batches:
        ids, lengths = batch.column("ids"), batch.column("lengths")
        cuts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        held = [packed(cuts, x.flatten().to_numpy()) for x in (ids, lengths)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("token", "block", "n", "least")] + held, ["token", "block", "n", "least", "ids", "lengths"])


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n, first_id, last_id) of rows of ``POSTINGS``."""
    for batch in batches:
        ids, size = flat(batch.column("ids"), np.int64)
        if len(size):
            at = np.cumsum(size) - size  # no list is empty
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(np.minimum.reduceat(ids, at)), pa.array(np.maximum.reduceat(ids, at))], ["token", "n", "first_id", "last_id"])


def _inverted(group: pa.Table) -> pa.Table:
    """The rows of ``postings`` of one block's messages (block, msg_id, dl, tokens), by length and id within a token."""
    group = group.sort_by([("dl", "ascending"), ("msg_id", "ascending")])
    lists = group.column("tokens").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    token = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[np.argsort(token, kind="stable")]
    n = np.bincount(token, minlength=len(coded.dictionary))
    cuts = np.concatenate([[0], np.cumsum(n)])
    dl = group.column("dl").to_numpy()[row].astype(np.int32)
    ids = group.column("msg_id").to_numpy()[row]
    block = np.full(len(n), group.column("block")[0].as_py(), np.int64)
    return pa.table([coded.dictionary, pa.array(block), pa.array(n, pa.int64()), pa.array(dl[cuts[:-1]]), packed(cuts, ids), packed(cuts, dl)], ["token", "block", "n", "least", "ids", "lengths"])


class Snapshot:
    """What one commit names; later ones don't change it."""

    def __init__(self, spark: SparkSession, path: str, commits: Commits, number: int, state: dict) -> None:
        self.spark, self.path, self.commits, self.number, self.state = spark, path, commits, number, state
        self.segments: list[dict] = state.get("segments", [])

    def snapshot(self) -> Snapshot:
        return self

    def _read(self, segments: list[dict], part: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        # one scan over the folders of all segments; a block's number tells its segment's
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['name']}/{part}" for s in segments])

    def _hidden(self, segments: list[dict]) -> DataFrame | None:
        """(msg_id, until): ids that are deleted, and the commit before which they were."""
        after = [x for x in self.state.get("deleted", []) if any(s["seq"] < x["seq"] for s in segments)]
        if not after:
            return None
        parts = [self.spark.read.schema("msg_id long").parquet(f"{self.path}/{x['name']}").withColumn("until", F.lit(x["seq"] << 40)) for x in after]
        out = reduce(DataFrame.unionAll, parts).groupBy("msg_id").agg(F.max("until").alias("until"))
        return F.broadcast(out) if sum(x["n"] for x in after) <= SENT_IDS else out

    def ids(self, segments: list[dict]) -> DataFrame:
        rows, gone = self._read(segments, "lengths", LENGTHS), self._hidden(segments)
        if gone is None:
            return rows
        return rows.join(gone.withColumnRenamed("msg_id", "_id"), (F.col("msg_id") == F.col("_id")) & (F.col("block") < F.col("until")), "left_anti")

    def met(self, given: DataFrame) -> DataFrame:
        """The ids that are indexed already, from the segments whose range meets that of ``given``."""
        segments = self.segments
        if segments:
            low, high = given.agg(F.min("msg_id"), F.max("msg_id")).first()
            segments = [s for s in segments if low is not None and s["low"] <= high and low <= s["high"]]
        return self.ids(segments).select("msg_id")

    def live(self, segments: list[dict], tokens: list[str] | None = None) -> DataFrame:
        """Rows of ``POSTINGS``, without what is deleted."""
        rows = self._read(segments, "postings", POSTINGS)
        if tokens is not None and len(tokens) <= NAMED:
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(NAMED))
            rows = rows.where(F.col("token").isin(tokens))
        elif tokens is not None:
            rows = rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in tokens], "token string")), "token", "left_semi")
        gone = self._hidden(segments)
        if gone is None:
            return rows
        pairs = rows.mapInArrow(_lists, BLOCKS).select("token", "block", F.explode(F.arrays_zip("ids", "lengths")).alias("x")).select("token", "block", F.col("x.ids").alias("msg_id"), F.col("x.lengths").alias("dl"))
        pairs = pairs.join(gone.withColumnRenamed("msg_id", "_id"), (F.col("msg_id") == F.col("_id")) & (F.col("block") < F.col("until")), "left_anti")
        lists = pairs.groupBy("token", "block").agg(F.sort_array(F.collect_list(F.struct("dl", "msg_id"))).alias("x"))
        lists = lists.select("token", "block", F.size("x").cast("long").alias("n"), F.col("x")[0]["dl"].alias("least"), F.col("x.msg_id").alias("ids"), F.col("x.dl").alias("lengths"))
        return lists.mapInArrow(_bytes, POSTINGS)

    def tokens(self, segments: list[dict]) -> DataFrame:
        """(msg_id, tokens) of the messages that are not deleted."""
        rows, gone = self._read(segments, "tokens", TOKENS), self._hidden(segments)
        if gone is not None:
            rows = rows.join(gone.withColumnRenamed("msg_id", "_id"), (F.col("msg_id") == F.col("_id")) & (F.shiftleft("seq", 40) < F.col("until")), "left_anti")
        return rows.select("msg_id", "tokens")

    def blocks(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, block, n, least, ids, lengths), of all tokens or of a stated list."""
        return self.live(self.segments, tokens).mapInArrow(_lists, BLOCKS)

    def extents(self) -> DataFrame:
        """(token, n, first_id, last_id) of each token in each block."""
        return self.live(self.segments).mapInArrow(_extents, "token string, n long, first_id long, last_id long")

    def postings(self) -> DataFrame:
        """(token, msg_id, dl): each pair once."""
        return self.blocks().select("token", F.explode(F.arrays_zip("ids", "lengths")).alias("x")).select("token", F.col("x.ids").alias("msg_id"), F.col("x.lengths").cast("long").alias("dl"))

    def lengths(self) -> DataFrame:
        """(msg_id, dl) of messages with a token."""
        return self.ids(self.segments).where("dl > 0").select("msg_id", "dl")

    def most_blocks(self) -> int:
        """No more blocks than this, by the commit."""
        return sum(s["blocks"] for s in self.segments)

    def totals(self) -> tuple[int, int]:
        """Messages with a token, and their tokens; known from the commit unless something is deleted."""
        segments = self.segments
        if self._hidden(segments) is None and all(s["held"] == s["docs"] for s in segments):
            return sum(s["held"] for s in segments), sum(s["tokens"] for s in segments)
        n, total = self.lengths().agg(F.count("*"), F.sum("dl")).first()
        return n, total or 0

    def norms(self) -> DataFrame:
        """(block, least, ids, norms): each message's root of its tokens' summed squared weights ln((N + 1) / (df + 1)) + 1. Worked out once for each commit."""
        path = f"{self.path}/norms-{self.number}"
        if not self.commits.exists(f"{path}/_SUCCESS"):
            n, total = self.totals()
            rows, squared = self.live(self.segments), (F.log((F.lit(n) + 1) / (F.col("_df") + 1)) + 1) ** 2
            # of tokens in so many messages there can't be more than may be sent, so texts are not shuffled for them; the others' lists are short
            least = max(FREQUENT, total // SENT_IDS + 1)
            frequent = checkpoint(rows.groupBy("token").agg(F.sum("n").alias("_df")).where(F.col("_df") >= least).select("token", squared.alias("w")))
            most = self.tokens(self.segments).select("msg_id", F.explode("tokens").alias("token")).join(F.broadcast(frequent), "token").groupBy("msg_id").agg(F.sum("w").alias("w"))
            rare = rows.join(F.broadcast(frequent), "token", "left_anti").mapInArrow(_lists, BLOCKS)
            rare = rare.groupBy("token").agg(F.sum("n").alias("_df"), F.flatten(F.collect_list("ids")).alias("ids")).select(F.explode("ids").alias("msg_id"), squared.alias("w"))
            sums = most.unionAll(rare).groupBy("msg_id").agg(F.sqrt(F.sum("w")).alias("norm"))

            def norm(group: pa.Table) -> pa.Table:  # a block: at most about BLOCK_DOCS messages
                group = group.sort_by("msg_id")
                one, norms = np.array([0, len(group)]), group.column("norm").to_numpy()
                return pa.table([group.column("block")[:1], pa.array([float(norms.min())]), packed(one, group.column("msg_id").to_numpy()), packed(one, norms)], ["block", "least", "ids", "norms"])

            blocked = sums.join(self.ids(self.segments).select("msg_id", "block"), "msg_id")
            blocked.select("block", "msg_id", "norm").groupBy("block").applyInArrow(norm, NORMS).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(NORMS).parquet(path)


class Index:
    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = text.fts_tokens) -> None:
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens
        self.commits = Commits(spark, f"{self.path}/commits")

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.path, self.commits, *self.commits.latest())

    def _of(self, state: dict) -> Snapshot:
        return Snapshot(self.spark, self.path, self.commits, -1, state)

    def segments(self) -> list[dict]:
        return self.snapshot().segments

    def postings(self) -> DataFrame:
        return self.snapshot().postings()

    def lengths(self) -> DataFrame:
        return self.snapshot().lengths()

    def update(self, messages: DataFrame) -> int:
        """Indexes the messages (msg_id, text) that are not yet, however they come; returns how many. Rows without an id are left out; of rows that share an id, one is taken."""
        given = messages.where("msg_id is not null").select(F.col("msg_id").cast("long").alias("msg_id"), "text")
        rows, ids = given.agg(F.count("*"), F.count_distinct("msg_id")).first()
        if rows > ids:  # else no text has to be shuffled
            given = given.groupBy("msg_id").agg(F.min("text").alias("text"))
        added = 0

        def step(state: dict) -> dict | None:
            nonlocal added
            # the texts of a first batch meet nothing and are not shuffled
            fresh = given.join(self._of(state).met(given), "msg_id", "left_anti") if state.get("segments") else given
            tokens = fresh.select("msg_id", F.array_distinct(F.coalesce(self.tokens(F.col("text")), F.array().cast("array<string>"))).alias("tokens"))
            segment = self._write(tokens, state.get("seq", 0) + 1, 0)
            added = segment["docs"] if segment else 0
            return {**state, "seq": segment["seq"], "segments": [*state.get("segments", []), segment]} if segment else None

        self.commits.change(step)
        if added:
            self.merge()
        return added

    def delete(self, ids: DataFrame) -> None:
        """Hides messages (msg_id) from now on; one that is indexed again later is visible again."""
        name = f"deleted-{uuid.uuid4().hex}"
        ids.where("msg_id is not null").select(F.col("msg_id").cast("long").alias("msg_id")).distinct().write.parquet(f"{self.path}/{name}")
        n = self.spark.read.schema("msg_id long").parquet(f"{self.path}/{name}").count()

        def step(state: dict) -> dict | None:
            if not n or not state.get("segments"):
                return None
            seq = state["seq"] + 1
            return {**state, "seq": seq, "deleted": [*state.get("deleted", []), {"name": name, "seq": seq, "n": n}]}

        self.commits.change(step)

    def rebuild(self) -> None:
        """One segment of everything, whatever the levels say."""
        self.merge(everything=True)

    def merge(self, everything: bool = False) -> None:
        """Merges levels that are full. The segments that are merged stay on disk until ``clean``, for readers under way."""
        while True:
            done = True

            def step(state: dict) -> dict | None:
                nonlocal done
                segments = state.get("segments", [])
                levels = sorted({s["level"] for s in segments})
                full = [level for level in levels if sum(s["level"] == level for s in segments) >= FANOUT]
                if not (everything and (len(segments) > 1 or state.get("deleted")) or full):
                    return None
                level = max(levels) if everything else full[0]
                old = [s for s in segments if everything or s["level"] == level]
                kept = [s for s in segments if s not in old]
                # a message that was hidden before the merge may be indexed again, so the segment takes the last number
                made = self._write(self._of(state).tokens(old), state["seq"] + 1, level + 1)
                first = min((s["seq"] for s in kept), default=None)
                deleted = [x for x in state.get("deleted", []) if first is not None and x["seq"] > first]
                done = everything
                return {**state, "seq": state["seq"] + 1, "segments": [*kept, *([made] if made else [])], "deleted": deleted}

            self.commits.change(step)
            if done:
                return

    def clean(self) -> None:
        """Removes the files of segments and norms that the latest commit doesn't name. For when no reader or writer is under way."""
        number, state = self.commits.latest()
        named = {s["name"] for s in state.get("segments", [])} | {x["name"] for x in state.get("deleted", [])} | {"commits", f"norms-{number}"}
        for status in self.commits._fs.listStatus(self.commits._path(self.path)):
            if status.getPath().getName() not in named:
                self.commits.remove(f"{self.path}/{status.getPath().getName()}")

    def _write(self, tokens: DataFrame, seq: int, level: int) -> dict | None:
        """Writes a segment of (msg_id, tokens)."""
        name = f"segment-{uuid.uuid4().hex}"
        tokens.select("msg_id", F.lit(seq).cast("long").alias("seq"), F.size("tokens").cast("long").alias("dl"), "tokens").write.parquet(f"{self.path}/{name}/tokens")
        staged = self.spark.read.schema(TOKENS).parquet(f"{self.path}/{name}/tokens")
        banded = staged.withColumn("band", _band(F.col("dl")))
        size = banded.groupBy("band").agg(F.count("*").alias("_n"), F.max("dl").alias("_dl"), F.min("msg_id").alias("_low"), F.max("msg_id").alias("_high"), F.sum("dl").alias("_sum")).collect()  # some hundred rows
        if not size:
            self.commits.remove(f"{self.path}/{name}")
            return None
        pieces = {r["band"]: max(-(-r["_n"] // BLOCK_DOCS), -(-r["_n"] * r["_dl"] // BLOCK_POSTINGS), 1) for r in size}
        small = self.spark.createDataFrame(list(pieces.items()), "band long, pieces long")
        block = F.lit(seq << 40) + F.col("band") * (1 << 24) + F.pmod(F.xxhash64("msg_id"), F.col("pieces"))
        blocked = banded.join(F.broadcast(small), "band").withColumn("block", block)
        blocked.select("msg_id", "dl", "block").write.parquet(f"{self.path}/{name}/lengths")
        # messages are shuffled, not postings: a block is inverted as a whole; what that gives is written, since ranges are found by a second look
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["_sum"] for r in size) // PART_POSTINGS))
        rows = checkpoint(blocked.select("block", "msg_id", "dl", "tokens").repartition(parts, "block").groupBy("block").applyInArrow(_inverted, POSTINGS))
        # a token that is in every block goes to many tasks
        rows.repartitionByRange(parts, "token", "block").sortWithinPartitions("token", "block").write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{self.path}/{name}/postings")
        return {
            "name": name, "seq": seq, "level": level, "docs": sum(r["_n"] for r in size), "low": min(r["_low"] for r in size), "high": max(r["_high"] for r in size),
            "held": sum(r["_n"] for r in size if r["_dl"]), "tokens": sum(r["_sum"] for r in size), "blocks": sum(pieces.values()),
        }
