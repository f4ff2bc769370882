"""Repeated windows across all texts: the part that removal by bytes and by words have in common.

Every window of a text is assigned an anchor, a place in it that depends on the window's content
alone, so equal windows have equal anchors at the same offset. Neighbouring windows with one anchor
form a block. A block is a few numbers (a hash of the anchor's surroundings, 128 bits of hashes of
all it covers, document, place, number of windows), so texts aren't shuffled. Blocks meet by anchor:

- an anchor that occurs once has no repeated window;
- a block whose whole content occurs earlier repeats in all its windows;
- what remains, first occurrences of different contents around one anchor, is looked at window by
  window by the caller (suffix arrays or names), from the texts again.

Within a task, blocks whose content the task has seen in an earlier document are settled at once, as
runs, so copies fold before they are shuffled (the memory for that is bounded; forgetting costs only
shuffle).

Documents are compared by id. Where ids are missing or repeat, rows are numbered in the order of id
(null first) and text instead, so that each row is a document of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SLICE_BYTES, bounded_batches, buffers, checkpoint, slices

SEEN = 2_000_000
#: Lists of runs are broadcast up to this many bytes in all; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Blocks of one anchor beyond which they are "wide": to be compared by a distributed aggregation.
WIDE = 2000
OPEN, TOO_WIDE = 1, 2
RUN = np.dtype([("at", "<i4"), ("count", "<i4")])
BLOCK = np.dtype([("at", "<i4"), ("count", "<i4"), ("anchor", "<i8")])
BLOCKS = "anchor long, ctx long, other long, doc long, at int, count int, settled boolean"
#: row, at, count, anchor and the two halves of a block's name: 128 bits of independent hashes of all it covers.
Blocks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): ``doc`` is the id where ids are unique, else the row's place by id and text."""
    slim = docs.select("doc_id", "text")
    odd = slim.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return slim.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    ordered = slim.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return checkpoint(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"))


class _Seen:
    """Contents (by their 128-bit names) a task has met, with the least document of each."""

    def __init__(self, within: bool) -> None:
        self.within = within
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.forget()

    def forget(self) -> None:
        self.keys, self.others, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting = 0

    def _merge(self) -> None:
        keys, others, docs = (np.concatenate(x) for x in zip((self.keys, self.others, self.docs), *self.new, strict=True))
        order = np.lexsort((docs, others, keys))
        keys, others, docs = keys[order], others[order], docs[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])])
        self.keys, self.others, self.docs, self.new, self.waiting = keys[first], others[first], docs[first], [], 0
        if len(self.keys) > SEEN:
            self.forget()

    def earlier(self, keys: np.ndarray, others: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which names were met in a document with a smaller number, or, if that counts, earlier in the same one."""
        if not len(keys):
            return np.zeros(0, bool)
        order = np.lexsort((docs, others, keys))  # stable, so places of one document stay in order
        k, o, d = keys[order], others[order], docs[order]
        head = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        out = np.empty(len(keys), bool)
        out[order] = ~head if self.within else d > d[np.flatnonzero(head)[np.cumsum(head) - 1]]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out |= (self.keys[at] == keys) & (self.others[at] == others) & (self.docs[at] < docs)
        self.new.append((k[head], o[head], d[head]))
        self.waiting += int(head.sum())
        if self.waiting > max(20_000, len(self.keys) // 4):
            self._merge()
        return out


def _runs(doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges windows' runs that touch; they come in order."""
    if not len(doc):
        return doc, at, count
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + count[:-1])])
    heads = np.flatnonzero(new)
    return doc[heads], at[heads], np.add.reduceat(count, heads)


def _emit(anchor, ctx, other, doc, at, count, settled) -> pa.RecordBatch:
    columns = [*[pa.array(x.view(np.int64)) for x in (anchor, ctx, other)], pa.array(doc, pa.int64()), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(settled)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "ctx", "other", "doc", "at", "count", "settled"])


def _blocks(docs: DataFrame, scheme: Callable[[np.ndarray, np.ndarray], Blocks], pieces: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]], within: bool) -> DataFrame:
    def cut(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slices of whole rows, and pieces of very long ones: (first row, first place, bytes, offsets)."""
        for lo, _, data, off in slices(raw, offsets):
            if len(data) <= 4 * SLICE_BYTES:
                yield lo, 0, data, off
            else:  # one long row, and shorter ones before it
                for i in range(len(off) - 1):
                    for base, piece in pieces(data[off[i] : off[i + 1]]):
                        yield lo + i, base, piece, np.array([0, len(piece)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(within)
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = buffers(batch.column(1))
            for lo, base, data, off in cut(raw, offsets):
                row, at, count, anchor, ctx, other = scheme(data, off)
                at = at + base
                doc = numbers[lo + row].astype(np.int64)
                done = seen.earlier(ctx, other, doc)
                d, a, c = _runs(doc[done], at[done], count[done])
                open_ = ~done
                spread = (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ a.astype(np.uint64)
                none = np.zeros(len(d), np.uint64)
                yield _emit(
                    np.concatenate([anchor[open_], spread]),
                    np.concatenate([ctx[open_], none]),
                    np.concatenate([other[open_], none]),
                    np.concatenate([doc[open_], d]),
                    np.concatenate([at[open_], a]),
                    np.concatenate([count[open_], c]),
                    np.arange(int(open_.sum()) + len(d)) >= open_.sum(),
                )

    return docs.select("doc", "text").mapInArrow(run, BLOCKS)


def _judged(blocks: DataFrame, within: bool) -> DataFrame:
    """(doc, at, count, anchor, open): settled blocks (0), and open ones that have to be looked at by window."""
    dealt = blocks.repartition("anchor").sortWithinPartitions("anchor", "settled", "ctx", "other", "doc", "at")

    def judge(anchor, ctx, other, doc, at, count, settled) -> pa.RecordBatch:
        head = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (settled[1:] != settled[:-1])])
        fresh = head | np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (other[1:] != other[:-1])])
        group = np.cumsum(head) - 1
        variety = np.bincount(group[fresh])[group]
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = ~fresh if within else doc > doc[first]
        done = settled | later
        open_ = ~done & (variety > 1)
        keep = np.flatnonzero(done | open_)
        state = np.where(done, 0, np.where(variety > WIDE, TOO_WIDE, OPEN)).astype(np.int32)
        columns = [pa.array(doc[keep]), pa.array(at[keep].astype(np.int32)), pa.array(count[keep].astype(np.int32)), pa.array(anchor[keep]), pa.array(state[keep])]
        return pa.RecordBatch.from_arrays(columns, ["doc", "at", "count", "anchor", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last anchor, which may go on
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut or held and held[0][0][0] != now[0][0]:
                yield judge(*[np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)])
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield judge(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return checkpoint(dealt.mapInArrow(run, "doc long, at int, count int, anchor long, open int"))


def _listed(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """(doc, entries): each document's entries in order, as the bytes of an array of ``kind``; runs that touch are merged."""
    grouped = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*kind.names))).alias("entries"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten(), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            table = np.empty(len(flat), kind)
            for name in kind.names:
                table[name] = flat.field(name).to_numpy(zero_copy_only=False)
            cells = []
            for i in range(batch.num_rows):
                part = table[at[i] : at[i + 1]]
                if kind == RUN:
                    reach = np.maximum.accumulate(part["at"].astype(np.int64) + part["count"])
                    heads = np.flatnonzero(np.concatenate([[True], part["at"][1:] > reach[:-1]]))
                    ends = reach[np.concatenate([heads[1:] - 1, [len(part) - 1]])]
                    part = part[heads].copy()
                    part["count"] = ends - part["at"]
                cells.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["doc", "entries"])

    return grouped.mapInArrow(pack, "doc long, entries binary")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with compressed texts, for a shuffle."""
    at, schema = docs.columns.index("text"), ", ".join(f"`{n}` {'binary' if n == 'text' else t}" for n, t in docs.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            cells = pa.array([None if x is None else tight.compress(x.encode()) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([cells if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(pack, schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``buffers`` of texts that may have come compressed."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        loose = zstandard.ZstdDecompressor()
        column = pa.array([None if x is None else loose.decompress(x) for x in column.to_pylist()], pa.large_binary())
    return buffers(column)


def repeated_runs(docs: DataFrame, scheme: Callable, pieces: Callable, opened: Callable[[DataFrame, Callable], DataFrame], within: bool) -> DataFrame:
    """(doc, entries): the runs (at, count) of windows of each document that occur earlier.

    ``docs`` has doc and text. ``scheme`` makes a slice's blocks; ``pieces`` cuts a very long text
    into (first place, bytes), so that each window lies in one of them whole. ``opened`` gets the open blocks and
    a function that attaches texts to some of them, (doc, text, entries), and returns repeated
    windows as (doc, at, count). ``within``: an earlier place in the same document counts.
    """
    bounded_batches(docs.sparkSession)
    judged = _judged(_blocks(docs, scheme, pieces, within), within)
    # lists of open blocks grow with the input, so they are joined by shuffle, with compressed texts
    packed = _packed_texts(docs.select("doc", "text"))
    ask = lambda blocks: packed.join(_listed(blocks, BLOCK).hint("merge"), "doc").select("doc", "text", "entries")
    found = judged.where("open = 0").select("doc", "at", "count").unionAll(opened(judged.where("open > 0"), ask).select("doc", "at", "count"))
    return _listed(found, RUN)


def covered(entries: bytes | None, length: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window of ``length`` of the runs (at, count)."""
    mark = np.zeros(size + 1, np.int32)
    if entries:
        runs = np.frombuffer(entries, RUN)
        at = runs["at"].astype(np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, np.minimum(at + runs["count"] + length - 1, size), -1)
    return np.cumsum(mark)[:size] > 0


def names(asked: DataFrame, ranges: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable]]) -> DataFrame:
    """(doc, at, anchor, name): each window of the asked blocks, named by its anchor and a hash of its content.

    ``ranges`` makes of a slice the rows' first symbols and a function that hashes windows from their starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = text_buffers(batch.column(1))
            for lo, hi, data, off in slices(raw, offsets):
                first, window = ranges(data, off)
                parts = [np.frombuffer(batch.column(2)[lo + i].as_py(), BLOCK) for i in range(hi - lo)]
                all_ = np.concatenate(parts)
                count = all_["count"].astype(np.int64)
                each = np.repeat(all_["at"].astype(np.int64), count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                row = np.repeat(np.repeat(np.arange(hi - lo), [len(p) for p in parts]), count)
                name = window(first[row] + each)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[lo:hi][row]), pa.array(each.astype(np.int32)), pa.array(np.repeat(all_["anchor"], count)), pa.array(name.view(np.int64))], ["doc", "at", "anchor", "name"])

    return checkpoint(asked.mapInArrow(run, "doc long, at int, anchor long, name long"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with their runs; broadcast only if they are measured to be small, else both sides are shuffled."""
    runs = checkpoint(runs)
    size = runs.agg(F.coalesce(F.sum(F.length("entries") + 16), F.lit(0))).first()[0]
    return docs.join(F.broadcast(runs), "doc", "left") if size <= BROADCAST_BYTES else _packed_texts(docs).join(runs, "doc", "left")
