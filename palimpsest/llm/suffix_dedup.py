"""Substring removal by bytes with suffix arrays.

A 100-byte window's anchor is the 32-byte string in it with the least hash, so a text of n bytes has
about n / 35 blocks (see ``repeats``). The contexts of blocks that share an anchor but not their
content are dealt by anchor to shards; a shard's contexts are one text, whose suffix array is made
by induced sorting, and the permuted common prefixes are computed on the bytes themselves: suffixes
whose neighbours share 100 bytes are equal windows, of which the earliest stays. An anchor with very
many different contexts would not fit one array: its windows are named instead, by 128 bits, and the
earliest of each name is found by a distributed aggregation.

Texts are UTF-8 bytes, matches never cross documents, and windows are judged on the input.

A very long text is looked at in overlapping pieces of about 1 MB, so memory doesn't follow it.

Defined cases: a null or empty text has no bytes and nothing removed; a repeated row is a document
of its own (see ``repeats.numbered``), so its text goes where it is long enough; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import BLOCK, OPEN, TOO_WIDE, Blocks, covered, names, numbered, repeated_runs, text_buffers, with_runs
from .suffix_array import common_prefixes, suffix_array
from .textkit import OTHER_KEY, SLICE_BYTES, U64, loads, mix, sliding_min, span_hashes, windows

LENGTH = 100
GRAM = 32
_PLACE = U64((1 << 27) - 1)  # of a slice or piece
#: Bytes of contexts that are sorted in one array; groups of one anchor stay together.
SHARD_BYTES = 1 << 20


def _scheme(data: np.ndarray, offsets: np.ndarray) -> Blocks:
    n = len(data)
    none = np.zeros(0, np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + LENGTH <= end)
    if not len(starts):
        return none, none, none, *[none.astype(U64)] * 3
    eight = loads(data)
    grams = windows(mix(eight[:n]), GRAM // 8, 8)[: n - GRAM + 1]
    p = np.arange(len(grams))
    anchor = (sliding_min((grams & ~_PLACE) | p.astype(U64), LENGTH - GRAM + 1)[starts] & _PLACE).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.concatenate([heads, [len(starts)]]))
    lo, a = starts[heads], anchor[heads]
    row = np.searchsorted(offsets, lo, "right") - 1
    place = (count * 1024 + a - lo).astype(U64)
    ctx = mix(span_hashes(eight, lo, lo + count - 1 + LENGTH) + place)
    other = span_hashes(eight, lo, lo + count - 1 + LENGTH, OTHER_KEY) + place
    return row, lo - offsets[row], count, grams[a], ctx, other


def _pieces(data: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    for lo in range(0, max(1, len(data) - LENGTH + 1), size):
        yield lo, data[lo : lo + size + LENGTH - 1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        text = raw.tobytes()
        rows = []
        for i in range(batch.num_rows):
            doc = batch.column(0)[i].as_py()
            for at, count, anchor in np.frombuffer(batch.column(2)[i].as_py(), BLOCK).tolist():
                a = int(offsets[i]) + at
                rows.append((anchor, doc, at, count, text[a : a + count - 1 + LENGTH]))
        for lo in range(0, len(rows), 20_000):
            columns = list(zip(*rows[lo : lo + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], ["anchor", "doc", "at", "count", "context"])


def _repeats_in(contexts: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(doc, at, 1) of the windows of (doc, at, count, context) that occur in an earlier one."""
    sizes = np.array([len(c[3]) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join(c[3] for c in contexts) + b"\0", np.uint8)
    text = data.astype(np.uint16) + np.uint16(1)
    text[begins[1:] - 1] = 0  # a separator below all bytes
    sa = suffix_array(text)
    # windows hold no separator, so their bytes can be compared as they are
    group = np.cumsum(common_prefixes(data, sa, LENGTH)[sa] < LENGTH)
    place = np.searchsorted(begins, sa, "right") - 1
    inside = sa - begins[place]
    window = inside < np.array([c[2] for c in contexts])[place]  # only these suffixes start a window of their block
    group, place, inside = group[window], place[window], inside[window]
    if len(group) < 2:
        return
    docs, ats = np.array([c[0] for c in contexts], np.int64)[place], np.array([c[1] for c in contexts], np.int64)[place] + inside
    order = np.lexsort((ats, docs, group))
    later = np.concatenate([[False], group[order][1:] == group[order][:-1]])
    out = order[later]
    out = out[np.lexsort((ats[out], docs[out]))]
    d, a = docs[out], ats[out]
    heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([heads, [len(d)]])) if len(d) else heads
    yield from zip(d[heads].tolist(), a[heads].tolist(), runs.tolist(), strict=True)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(contexts: list) -> pa.RecordBatch:
        found = list(_repeats_in(contexts))
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc", "at", "count"])

    now, size, last = [], 0, None
    for batch in batches:
        for anchor, doc, at, count, context in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if anchor != last and size >= SHARD_BYTES:
                yield out(now)
                now, size = [], 0
            last = anchor
            now.append((doc, at, count, context))
            size += len(context) + 1
    if now:
        yield out(now)


def _windows(data: np.ndarray, offsets: np.ndarray):
    eight = loads(data)
    return offsets, lambda at: span_hashes(eight, at, at + LENGTH, OTHER_KEY)


def _opened(blocks: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    contexts = ask(blocks.where(F.col("open") == OPEN)).mapInArrow(_contexts, "anchor long, doc long, at int, count int, context binary")
    found = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, "doc long, at int, count int")
    wide = blocks.where(F.col("open") == TOO_WIDE)
    if not wide.limit(1).count():
        return found
    named = names(ask(wide), _windows)
    place = F.struct("doc", "at")
    least = named.groupBy("anchor", "name").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return found.unionAll(named.join(least, ["anchor", "name"]).where(place > F.col("_first")).select("doc", "at", F.lit(1).alias("count")))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; ``kept`` is the remaining bytes."""
    rows = numbered(docs)
    runs = repeated_runs(rows, _scheme, _pieces, _opened, within=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                data, entries = raw[offsets[i] : offsets[i + 1]], batch.column(2)[i].as_py()
                gone = covered(entries, LENGTH, len(data)) if entries else np.zeros(len(data), bool)
                kept = data[~gone].tobytes() if entries else data.tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_runs(rows, runs).select("doc_id", "text", "entries").mapInArrow(cut, schema)


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
