"""Ranked lexical search with block-max pruning over a forward index of document ranges.

``build`` cuts the documents, in the order they are stored, into blocks of at most ``BLOCK_DOCS``. A
block is a row: its vocabulary, for each term the documents that hold it and its impacts, and a
forward index (each document's terms and how often it holds them). A term's impacts are its pairs of
occurrences and document length that no other document of the block beats in both, so a block's
maximum follows exactly for any collection statistics and the index can grow without being rewritten.

``search`` asks a stated set of items. One pass over the vocabularies keeps what concerns the items'
terms: frequencies, which give the terms' weights, and maxima, which give each item's bound in each
block. The blocks of the largest bounds are scored first; the tenth best score is the item's
threshold. Then the blocks whose bound reaches it are scored from the forward index; a task raises
its thresholds as it goes and skips what falls below. Only these blocks meet the Python workers, and
no texts are shuffled. Scores are sums of integers and exact.

Terms are maximal runs of bytes outside ``\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F`` with A-Z lower-cased.

Defined cases: a null or empty text, or one without a term, is in no block and doesn't count; a
document without an id counts in the statistics and is never returned; rows that share an id are
documents of their own; an item without a term returns nothing; equal items are asked once; items
that share an id but not a text are ranked each on its own; equal scores go by ascending id.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .textkit import bounded_batches, buffers, checkpoint, shared_dir, slices

BLOCK_DOCS = 64
#: Bytes of a block's texts, unless one text has more.
BLOCK_BYTES = 1 << 20
#: Terms of the items of one pass, repeats included: tables of some MB in a worker.
PASS_TERMS = 50_000
PASS_ITEMS = 1000
#: Blocks of the largest bounds that set an item's first threshold.
FIRST = 4
#: Bytes of block and item lists up to which they are sent to all tasks instead of dealt with the index.
SENT_BYTES = 32 << 20
#: The formula's constants.
TOP, FLOOR_M, BY_LENGTH, SCALE = 1_000_000_000, 25, 75, 1000

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_I4, _I8 = np.dtype("<i4"), np.dtype("<i8")

_PARTS = ("vocabulary", "df", "impacts", "impact_tf", "impact_n", "ids", "n", "held", "term", "tf")
INDEX = "block long, docs long, terms long, " + ", ".join(f"{c} binary" for c in _PARTS)
_BOUNDS = ["block", "vocabulary", "df", "impacts", "impact_tf", "impact_n"]
_FORWARD = ["block", "vocabulary", "ids", "n", "held", "term", "tf"]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of some rows as byte strings, and each row's first term (one more than rows)."""
    low, inside = _LOWER[data], _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return found, np.searchsorted(starts, offsets)


def _block(number: int, found: pa.Array, row: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple | None:
    n = np.diff(row)
    if not n.sum():
        return None
    coded = found.dictionary_encode()
    size, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    pair, tf = np.unique(doc * size + code, return_counts=True)
    doc, term = pair // size, pair % size
    df = np.bincount(term, minlength=size)
    # documents without an id count, but can't be found
    doc, term, tf = (x[known[doc]] for x in (doc, term, tf))
    order = np.lexsort((-tf, n[doc], term))
    rank = term[order] * (int(tf.max(initial=0)) + 1) + tf[order]
    best = np.ones(len(rank), bool)
    best[1:] = rank[1:] > np.maximum.accumulate(rank)[:-1]  # by length, and more often than in all shorter documents
    at = order[best]
    kept = np.flatnonzero(known & (n > 0))
    place = np.full(len(n), -1)
    place[kept] = np.arange(len(kept))
    parts = [
        (df, _I4), (np.bincount(term[at], minlength=size), _I4), (tf[at], _I4), (n[doc[at]], _I4),
        (ids[kept], _I8), (n[kept], _I4), (np.bincount(place[doc], minlength=len(kept)), _I4), (term, _I4), (tf, _I4),
    ]
    words = b" ".join(coded.dictionary.to_pylist())
    return number, int((n > 0).sum()), int(n.sum()), words, *[np.asarray(x).astype(t).tobytes() for x, t in parts]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_INDEX_ARROW = pa.schema([(c, pa.int64()) for c in ("block", "docs", "terms")] + [(c, pa.binary()) for c in _PARTS])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        raw, offsets = buffers(batch.column(1))
        for lo, hi, data, off in slices(raw, offsets, BLOCK_BYTES):
            rows = []
            for a in range(0, hi - lo, BLOCK_DOCS):
                b = min(a + BLOCK_DOCS, hi - lo)
                found, row = terms(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if made := _block(number, found, row, ids[lo + a : lo + b], known[lo + a : lo + b]):
                    rows.append(made)
                    number += 1
            if rows:
                yield _rows(rows, _INDEX_ARROW)


def build(docs: DataFrame, path: str) -> None:
    """Writes the index of ``docs`` (doc_id, text) as Parquet: one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_index, INDEX).write.option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def item_terms(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return terms(data, np.array([0, len(data)]))[0].to_pylist()


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows of a vocabulary column, and each row's first."""
    lists = pc.split_pattern(column.cast(pa.large_binary()), b" ")
    return lists.flatten(), lists.offsets.to_numpy().astype(np.int64)


class Asked:
    """The items of one pass: their terms, and for each item which of them it holds, how often, and later with what weight."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        self.ids = [i for i, _ in items]
        self.terms = sorted({t for _, ts in items for t in ts})
        at = {t: k for k, t in enumerate(self.terms)}
        counts = [Counter(ts) for _, ts in items]
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int64)
        self.term = np.array([at[t] for c in counts for t in c], np.int64)
        self.count = np.array([n for c in counts for n in c.values()], np.int64)
        self.weight = np.zeros(len(self.term), np.int64)

    def weigh(self, n: int, df: dict[int, int]) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)
        self.weight = w[self.term] * self.count

    def matrix(self, items: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Weights of some items (rows) over some terms (columns), as doubles if all sums stay exact in them."""
        size = self.first[items + 1] - self.first[items]
        at = np.repeat(self.first[items] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.full(len(self.terms) + 1, -1)
        place[held] = np.arange(len(held))
        column = place[self.term[at]]
        exact = int(np.add.reduceat(np.abs(self.weight), self.first[:-1]).max(initial=0)) * (TOP // SCALE) < 1 << 53
        out = np.zeros((len(items), len(held)), float if exact else np.int64)
        keep = column >= 0
        out[np.repeat(np.arange(len(items)), size)[keep], column[keep]] = self.weight[at[keep]]
        return out


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term's occurrences add in a document of n terms, in 64-bit integers."""
    if len(n) and BY_LENGTH * int(n.max()) * docs >= 1 << 63:
        m = np.array([FLOOR_M + BY_LENGTH * int(x) * docs // total for x in n], np.int64)
    else:
        m = FLOOR_M + BY_LENGTH * n * docs // total
    return TOP * tf // (SCALE * tf + 8 * m)


def _cells(batch: pa.RecordBatch, name: str, row: int, kind: np.dtype = _I4) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind).astype(np.int64)


def _probe(index: DataFrame, shared, docs: int, total: int) -> DataFrame:
    """(block, term, df, top): of each block the asked terms it holds, in how many documents, and their maxima."""
    out = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("df", pa.binary()), ("top", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value.terms, pa.large_binary())
        for batch in batches:
            words, first = _split(batch.column(1))
            code = pc.index_in(words, known).fill_null(-1).to_numpy()
            rows = []
            for i in range(batch.num_rows):
                here = code[first[i] : first[i + 1]]
                hit = np.flatnonzero(here >= 0)
                if not len(hit):
                    continue
                many = _cells(batch, "impacts", i)
                value = impact(_cells(batch, "impact_tf", i), _cells(batch, "impact_n", i), docs, total)
                ends = np.cumsum(many)
                top = np.zeros(len(many), np.int64)
                some = many > 0
                if len(value):
                    top[some] = np.maximum.reduceat(value, (ends - many)[some])
                rows.append((batch.column(0)[i].as_py(), here[hit].astype(_I4).tobytes(), _cells(batch, "df", i)[hit].astype(_I4).tobytes(), top[hit].astype(_I4).tobytes()))
            yield _rows(rows, out)

    return checkpoint(index.select(*_BOUNDS).mapInArrow(run, "block long, term binary, df binary, top binary"))


def _frequencies(probe: DataFrame, n: int) -> dict[int, int]:
    """Documents that hold each asked term: summed in each task, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                sums[_cells(batch, "term", i)] += _cells(batch, "df", i)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["t", "df"])

    return {r["t"]: r["df"] for r in probe.select("term", "df").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()}


def _bounds(batch: pa.RecordBatch, asked: Asked) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bound of every item) of the blocks of a batch."""
    top = np.zeros(len(asked.terms), np.int64)
    for i in range(batch.num_rows):
        held = _cells(batch, "term", i)
        top[held] = _cells(batch, "top", i)
        yield i, np.add.reduceat(asked.weight * top[asked.term], asked.first[:-1])
        top[held] = 0


def _first_bounds(probe: DataFrame, shared, most: int) -> dict[int, int]:
    """Each item's ``most``-th largest bound; items with fewer blocks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = np.zeros((0, len(asked.ids)), np.int64)
        for batch in batches:
            best = np.concatenate([best, *[b[None] for _, b in _bounds(batch, asked)]])
            best = -np.sort(-best, axis=0)[:most]
        at = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[1]), pa.array(best[at])], ["item", "bound"])

    rows = probe.select("block", "term", "top").mapInArrow(run, "item long, bound long")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound")))).where(F.col("_r") <= most)
    return {r["item"]: r["b"] for r in ranked.groupBy("item").agg(F.min("bound").alias("b"), F.count("*").alias("n")).where(F.col("n") == most).collect()}


def _reaching(probe: DataFrame, shared, least: np.ndarray) -> DataFrame:
    """(block, items, bounds): the items whose bound in a block reaches what ``least`` says, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("block", pa.int64()), ("items", pa.binary()), ("bounds", pa.binary())])
        for batch in batches:
            rows = []
            for i, b in _bounds(batch, shared.value):
                at = np.flatnonzero(b >= least)
                if len(at):
                    rows.append((batch.column(0)[i].as_py(), at.astype(_I4).tobytes(), b[at].astype(_I8).tobytes()))
            yield _rows(rows, out)

    return checkpoint(probe.select("block", "term", "top").mapInArrow(run, "block long, items binary, bounds binary"))


def _score(index: DataFrame, chosen: DataFrame, shared, least: np.ndarray, k: int, docs: int, total: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best documents of the chosen blocks, for each item and task."""
    sent = chosen.agg(F.coalesce(F.sum(F.length("items") + F.length("bounds") + 16), F.lit(0))).first()[0] <= SENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = shared.value, np.maximum(least, 1)
        known = pa.array(asked.terms, pa.large_binary())
        best: list[list[tuple[int, int]]] = [[] for _ in asked.ids]
        for batch in batches:
            words, first = _split(batch.column(batch.schema.get_field_index("vocabulary")))
            code = pc.index_in(words, known).fill_null(-1).to_numpy()
            for i in range(batch.num_rows):
                items, bounds = _cells(batch, "items", i), _cells(batch, "bounds", i, _I8)
                items = items[bounds >= floor[items]]
                if not len(items):
                    continue
                ids, n = _cells(batch, "ids", i, _I8), _cells(batch, "n", i)
                term = code[first[i] : first[i + 1]][_cells(batch, "term", i)]
                hit = np.flatnonzero(term >= 0)
                doc = np.repeat(np.arange(len(ids)), _cells(batch, "held", i))[hit]
                held, column = np.unique(term[hit], return_inverse=True)
                value = impact(_cells(batch, "tf", i)[hit], n[doc], docs, total)
                for lo in range(0, len(items), 64):
                    part = items[lo : lo + 64]
                    weights = asked.matrix(part, held)
                    grid = np.zeros((len(ids), len(held)), weights.dtype)
                    grid[doc, column] = value
                    scores = (grid @ weights.T).astype(np.int64)
                    for d, c in zip(*np.nonzero(scores >= floor[part]), strict=True):
                        item, entry = int(part[c]), (int(scores[d, c]), -int(ids[d]))
                        heap = best[item]
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        if len(heap) == k:
                            floor[item] = max(floor[item], heap[0][0])
        rows = [(item, -x, s) for item, heap in enumerate(best) for s, x in heap]
        yield _rows(rows, pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    joined = index.select(*_FORWARD).join(F.broadcast(chosen) if sent else chosen, "block")
    got = joined.mapInArrow(run, "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pass(index: DataFrame, items: list, k: int, docs: int, total: int) -> DataFrame:
    spark = index.sparkSession
    asked = Asked(items)
    probe = _probe(index, spark.sparkContext.broadcast(asked), docs, total)
    asked.weigh(docs, _frequencies(probe, len(asked.terms)))
    shared = spark.sparkContext.broadcast(asked)
    least = np.ones(len(items), np.int64)
    for item, bound in _first_bounds(probe, shared, FIRST).items():
        least[item] = max(bound, 1)
    early = _score(index, _reaching(probe, shared, least), shared, np.ones(len(items), np.int64), k, docs, total)
    least = np.ones(len(items), np.int64)
    for r in early.where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    got = _score(index, _reaching(probe, shared, least), shared, least, k, docs, total)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(asked.ids)], "item long, item_id long")
    return got.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most PASS_ITEMS rows


RESULT = "item_id long, rank int, doc_id long, score long"


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each of ``items`` (item_id, text).

    The items are a stated set: they are read by a local iterator and asked in passes of at most
    ``PASS_ITEMS`` items and about ``PASS_TERMS`` terms, against all blocks.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    docs, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    out, now, n = [], [], 0
    if docs:
        for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
            if ts := item_terms(r["text"]):
                now.append((r["item_id"], ts))
                n += len(ts)
                if n >= PASS_TERMS or len(now) >= PASS_ITEMS:
                    out, now, n = [*out, _pass(index, now, k, docs, total)], [], 0
        if now:
            out.append(_pass(index, now, k, docs, total))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], RESULT)


def query(spark, sf_dir):
    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    build(table(spark, sf_dir, "documents"), path)
    return search(load(spark, path), table(spark, sf_dir, "benchmark"))


_EXTRACT = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_EXTRACT.format("coalesce(text, '')")} AS ts FROM documents), e AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM e), t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM e) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, g GROUP BY term, nn),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_EXTRACT.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
