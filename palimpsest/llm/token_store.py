"""Token ids of all documents, in id order, in shard files that hold a wavelet matrix each.

Documents are range-partitioned by id and sorted, a task turns its run of documents into shards of
about ``SHARD_TOKENS`` ids, and a shard is one row of a Parquet table in the shared folder: its
documents' ids and lengths, and one byte string with the wavelet matrix of all their tokens. The
files are then read back: every id that leaves this module was decoded from them.

The vocabulary's normaliser drops case, and its pre-tokeniser never joins across ASCII white space nor
an ASCII letter and a stop after it, so such a part's ids don't depend on its neighbours: each distinct
part is encoded once by a worker, which remembers a bounded number of them from task to task. Parts
are told apart by two independent hashes of 64 bits; where those disagree, and where the first text of
a batch, encoded whole, has other ids than its parts, texts are encoded whole instead. The vocabulary
file is broadcast, so only the driver needs its path.

``access``, ``count`` and ``occurrences`` answer questions about single tokens from the files: a shard's
matrix carries its rank directory, so only the chunks that a question meets are unpacked.

Defined cases: a null or empty text is the end id alone; a null id sorts first and is kept; repeated
rows are encoded one by one; an empty table gives no shards. One document is never cut, so a shard
can exceed the usual size by one document.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_groups, table
from .textkit import bounded_batches, buffers, shared_dir, slices, words
from .wavelet import WaveletMatrix

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
#: Distinct parts that a worker remembers; then it starts anew.
CACHE_WORDS = 2_000_000
#: A batch is held against one whole text of at most this many bytes.
PROBE_BYTES = 2048
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True
#: Bytes of a vocabulary file up to which it is broadcast.
MOST_VOCABULARY = 256 << 20
_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """This process's encoder of a vocabulary (the content of its file)."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


class _Growing:
    """An array that is appended to, with room to spare, so that appending costs what is appended."""

    def __init__(self, start: list, kind: type) -> None:
        self.room, self.n = np.zeros(1024, kind), 0
        self.extend(np.array(start, kind))

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(2 * len(x) + self.n, self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.n]


class _Index:
    """Hash -> slot: a large sorted table, and a small one of late entries that is merged into it now and then."""

    def __init__(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.tables)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 where there is none."""
        out = np.full(len(keys), -1)
        for known, slots in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, slots[at], out)
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Adds new keys, in order."""
        (large, old), (known, have) = self.tables
        at = np.searchsorted(known, keys)
        known, have = np.insert(known, at, keys), np.insert(have, at, slots)
        if len(known) > max(10_000, len(large) // 8):
            at = np.searchsorted(large, known)
            large, old = np.insert(large, at, known), np.insert(old, at, have)
            known, have = known[:0], have[:0]
        self.tables = [(large, old), (known, have)]


class Encoder:
    """Encodes rows of bytes to ids, each distinct word once."""

    def __init__(self, vocabulary: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        top = max(END_ID, *self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.bits = max(16, top.bit_length())
        self.kind = np.uint16 if self.bits == 16 else np.uint32
        self.mark_id, token = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = token.content.encode()
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        # by slot: the second hash and the end of the ids
        self.sure, self.flat, self.at = _Growing([], np.uint64), _Growing([], self.kind), _Growing([0], np.int64)

    def _fresh(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts, one after the other, and how many each has.

        All go through the tokeniser as one text, set apart by a control string of the vocabulary;
        parts that may hold control strings themselves go alone.
        """
        alone = [k for k, p in enumerate(parts) if b"<|" in p]
        text = self.mark.join(b"" if b"<|" in p else p for p in parts).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        cut = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        flat = ids[ids != self.mark_id]
        if alone:
            pieces = np.split(flat, np.cumsum(sizes)[:-1])
            for k in alone:
                pieces[k] = np.array(self.tokenizer.encode(parts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)
            flat, sizes = np.concatenate(pieces), np.array([len(x) for x in pieces])
        return flat.astype(self.kind), sizes

    def whole(self, data: bytes) -> np.ndarray:
        """Ids of one text, encoded as it is, with the end id."""
        ids = self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array([*ids, END_ID], self.kind)

    def checked(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, held against the first text of middling length; all are encoded whole if that differs."""
        out, at = self.encode(data, offsets)
        probe = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) <= PROBE_BYTES))[:1]
        if len(probe):
            i = int(probe[0])
            if not np.array_equal(out[at[i] : at[i + 1]], self.whole(data[offsets[i] : offsets[i + 1]].tobytes())):
                return self._rows(data, offsets)
        return out, at

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.whole(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([np.zeros(0, self.kind), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with the end id after each row, and the rows' offsets in them."""
        breaks = np.zeros(len(data), bool)
        breaks[1:] = _STOP[data[1:]] & _LETTER[data[:-1]]
        raw = data.tobytes()
        # control strings of the vocabulary are told by case; they hold "<|"
        starts, ends, h, row, check = words(data, offsets, lower=b"<|" not in raw, breaks=breaks, check=True)
        codes, uniq = pd.factorize(h)
        first = np.empty(len(uniq), np.int64)
        first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
        sure = check[first]
        if (sure[codes] != check).any():
            return self._rows(data, offsets)
        if len(self.index) + len(uniq) > CACHE_WORDS:
            self.forget()
        slot = self.index.find(uniq)
        have = slot >= 0
        if (self.sure.now[slot[have]] != sure[have]).any():
            return self._rows(data, offsets)
        new = np.flatnonzero(~have)
        if len(new):
            new = new[np.argsort(uniq[new])]
            flat, sizes = self._fresh([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            slot[new] = np.arange(self.sure.n, self.sure.n + len(new))
            self.flat.extend(flat)
            self.at.extend(self.at.now[-1] + np.cumsum(sizes))
            self.sure.extend(sure[new])
            self.index.add(uniq[new], slot[new])
        slot, at = slot[codes], self.at.now
        size = at[slot + 1] - at[slot]
        ends_at = np.concatenate([[0], np.cumsum(size)])
        total = ends_at[row[1:]] - ends_at[row[:-1]]
        out_at = np.concatenate([[0], np.cumsum(total + 1)])
        out = np.full(int(out_at[-1]), END_ID, self.kind)
        source = np.repeat(at[slot] - ends_at[:-1], size) + np.arange(int(ends_at[-1]))
        target = np.arange(int(ends_at[-1])) + np.repeat(np.arange(len(total)), total)
        out[target] = self.flat.now[source]
        return out, out_at


SHARDS = "shard string, first_doc long, doc_ids array<long>, lengths array<long>, n_tokens long, matrix binary"


def _shard(ids: list, lengths: list[int], tokens: list[np.ndarray], key: str, bits: int) -> pa.RecordBatch:
    flat = np.concatenate(tokens)
    row = [[key], [ids[0]], [ids], [lengths], [len(flat)], [WaveletMatrix.build(flat, bits).to_bytes()]]
    types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["shard", "first_doc", "doc_ids", "lengths", "n_tokens", "matrix"])


def write(docs: DataFrame, path: str, vocabulary: bytes) -> None:
    """Writes the shards of ``docs`` (doc_id, text) to ``path``; ``vocabulary`` is the content of the file."""
    bounded_batches(docs.sparkSession)
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError("the vocabulary is too large to be broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine, part, k = encoder(shared.value), TaskContext.get().partitionId(), 0
        ids, lengths, tokens, n = [], [], [], 0
        for batch in batches:
            names = batch.column(0).cast(pa.int64()).to_pylist()
            raw, offsets = buffers(batch.column(1))
            for lo, hi, data, off in slices(raw, offsets):
                out, at = mine.checked(data, off)
                for i in range(hi - lo):
                    ids.append(names[lo + i])
                    lengths.append(int(at[i + 1] - at[i]))
                    tokens.append(out[at[i] : at[i + 1]])
                    n += lengths[-1]
                    if n >= SHARD_TOKENS:
                        yield _shard(ids, lengths, tokens, f"{part:010d}-{k:08d}", mine.bits)
                        ids, lengths, tokens, n, k = [], [], [], 0, k + 1
        if ids:
            yield _shard(ids, lengths, tokens, f"{part:010d}-{k:08d}", mine.bits)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # shards are compressed already
    ordered.mapInArrow(encode, SHARDS).write.option("compression", "uncompressed").parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """(shard, _start): tokens before each shard. Sums run over a task's shards, then over tasks, so no window holds all shards."""
    slim = shards.select("shard", "n_tokens", F.substring_index("shard", "-", 1).alias("_part"))
    parts = slim.groupBy("_part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("_part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return join_groups(slim.select("shard", "_part", inner.alias("_inner")), parts.select("_part", before.alias("_before")), ["_part"]).select("shard", (F.col("_inner") + F.col("_before")).alias("_start"))


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, decoded from the shard files."""
    bounded_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, ids, lengths = (batch.column(i)[k].as_py() for i in range(3))
                flat = WaveletMatrix.from_bytes(batch.column(3)[k].as_py()).decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                for lo in range(0, len(ids), 512):  # small batches out: ids take four bytes here
                    rows = range(lo, min(lo + 512, len(ids)))
                    raw = [flat[at[i] : at[i + 1]].tobytes() for i in rows]
                    columns = [pa.array([shard] * len(rows)), pa.array([ids[i] for i in rows], pa.int64()), pa.array([at[i] for i in rows], pa.int64()), pa.array([lengths[i] for i in rows], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "_at", "n_tokens", "ids_crc32"])

    rows = shards.select("shard", "doc_ids", "lengths", "matrix").mapInArrow(decode, "shard string, doc_id long, _at long, n_tokens long, ids_crc32 long")
    joined = join_groups(rows, starts(shards), ["shard"])
    return joined.select("doc_id", (F.col("_at") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def access(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, at, token) for each row of ``wanted`` (doc_id, at): a document's token by its place, null where there is none.

    Places are dealt to the shards that hold them, at most a shard's own number of tokens each.
    """
    bounded_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n = batch.column(1)[k].values, batch.column(2)[k].values
                at = pa.array(np.cumsum(n.to_numpy()) - n.to_numpy())
                for lo in range(0, len(ids), 10_000):
                    part = slice(lo, lo + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(ids[part])), ids[part], n[part], at[part]], ["shard", "_doc", "_n", "_at"])

    index = shards.select("shard", "doc_ids", "lengths").mapInArrow(spread, "shard string, _doc long, _n long, _at long")
    asked = wanted.select("doc_id", "at").distinct()
    placed = asked.join(index, asked["doc_id"].eqNullSafe(index["_doc"])).where("at >= 0 and at < _n")
    places = placed.groupBy("shard").agg(F.collect_list(F.struct("doc_id", "at", (F.col("_at") + F.col("at")).alias("place"))).alias("places"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = batch.column(0)[k].values
                found = WaveletMatrix.from_bytes(batch.column(1)[k].as_py()).access(cells.field("place").to_numpy())
                yield pa.RecordBatch.from_arrays([cells.field("doc_id"), cells.field("at"), pa.array(found.astype(np.int64))], ["doc_id", "at", "token"])

    types = dict(wanted.dtypes)
    got = places.join(shards.select("shard", "matrix"), "shard").select("places", "matrix").mapInArrow(look, f"doc_id {types['doc_id']}, at {types['at']}, token long")
    same = asked["doc_id"].eqNullSafe(got["doc_id"]) & (asked["at"] == got["at"])
    return asked.join(got, same, "left").select(asked["doc_id"], asked["at"], got["token"])


def _asked(spark, path: str, tokens: list[int], answer, schema: str, columns: list[str]) -> DataFrame:
    bounded_batches(spark)
    asked = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(i)[k].as_py() for i in range(len(columns))]
                matrix = WaveletMatrix.from_bytes(row[-1])
                for t in asked:
                    yield from answer(t, matrix, *row[:-1])

    return spark.read.schema(SHARDS).parquet(path).select(*columns).mapInArrow(run, schema)


def count(spark, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each stated id in all files, from the rank directories."""

    def answer(t: int, matrix: WaveletMatrix) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([matrix.count(t)], pa.int64())], ["token", "n"])

    return _asked(spark, path, tokens, answer, "token long, n long", ["matrix"]).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark, path: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, at) of each occurrence of the stated ids."""

    def answer(t: int, matrix: WaveletMatrix, ids: list, lengths: list[int]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(lengths)
        found = matrix.occurrences(t)
        for lo in range(0, len(found), 10_000):
            part = found[lo : lo + 10_000]
            doc = np.searchsorted(ends, part, "right")
            at = part - np.concatenate([[0], ends])[doc]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t)), pa.array([ids[i] for i in doc], pa.int64()), pa.array(at)], ["token", "doc_id", "at"])

    return _asked(spark, path, tokens, answer, "token long, doc_id long, at long", ["doc_ids", "lengths", "matrix"])


def store(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the shards and reads every document back from them; ``vocabulary`` is the file's path on the driver."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    with open(vocabulary, "rb") as f:
        write(docs, path, f.read())
    return read(docs.sparkSession, path)


def query(spark, sf_dir):
    return store(table(spark, sf_dir, "documents"))
