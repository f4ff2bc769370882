"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of five-word shingles. Of an item with n shingles, a document
that contains the share t can lack at most n - ceil(t * n) of them, so it holds at least one of any
n - ceil(t * n) + 1. Those with the smallest hashes are taken: a bottom-k MinHash sketch whose depth
is set by the partition's largest size, so the search loses nothing, however long the document is.
A document's shingles probe the sketches; each candidate pair is verified once by exact containment
of the item's shingles, on words and not on hashes.

The items are the stated query set: they are searched in blocks of at most ``BLOCK_SHINGLES``
shingles, each of which fits a worker, against all documents; one pass over the documents a block.
Nothing is shuffled.

Words are lower-cased (A-Z); an item with fewer than five words is one shingle of all its words.

Defined cases: null or empty items match nothing; null or empty documents contain nothing; repeated
documents are each reported, repeated items once per distinct row; empty tables give no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .textkit import bounded_batches, buffers, ngrams, slices, words

SHINGLE = 5
SHARE = 0.8
#: Shingles of one block of items: a word's bytes and at most 24 bytes of sketch each, so some tens of MB in a worker.
BLOCK_SHINGLES = 1_000_000
SCHEMA = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def _word_lists(text: str | None) -> list[bytes]:
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    raw = (text or "").encode().translate(lower).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
    return [w for w in raw.split(b" ") if w]


def _shingles(ws: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)}


class Block:
    """A block of items as arrays: sketch hash -> items, and each item's shingle hashes and words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], share: float, shingle: int) -> None:
        self.share, self.ids, self.sizes, self.lengths, self.texts = share, [], [], [], []
        hashes: list[np.ndarray] = []
        for item, ws in items:
            k = min(shingle, len(ws))
            text = b" ".join(ws)
            data = np.frombuffer(text, np.uint8)
            _, _, h, row = words(data, np.array([0, len(data)]))
            grams = np.unique(ngrams(h, row, k)[0])
            self.ids.append(item)
            self.lengths.append(k)
            hashes.append(grams)
            self.texts.append(text)
            self.sizes.append(len(_shingles(ws, k)))
        probes, owners, kinds = [], [], []
        for i, (n, grams) in enumerate(zip(self.sizes, hashes, strict=True)):
            top = 1 << (n - 1).bit_length()  # the size partition's largest size
            depth = min(n, top - math.ceil(round(share * top, 9)) + 1)
            probes.append(grams[:depth])
            owners.append(np.full(depth, i))
            kinds.append(np.full(depth, self.lengths[i]))
        self.by_length = {}
        if probes:
            probe, owner, kind = np.concatenate(probes), np.concatenate(owners), np.concatenate(kinds)
            for k in np.unique(kind):
                order = np.argsort(probe[kind == k], kind="stable")
                self.by_length[int(k)] = (probe[kind == k][order], owner[kind == k][order])

    def search(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, texts = batch.column(0), batch.column(1)
        raw, offsets = buffers(texts)
        for lo, _, data, off in slices(raw, offsets):
            _, _, h, row = words(data, off, lower=True)
            pairs = set()
            for k, (probe, owner) in self.by_length.items():
                grams, inside = ngrams(h, row, k)
                at = np.searchsorted(probe, grams)
                at[at == len(probe)] = 0
                hit = np.flatnonzero((probe[at] == grams) & inside)
                if len(hit):
                    doc = np.searchsorted(row, hit, "right") - 1
                    for d, g in set(zip(doc.tolist(), grams[hit].tolist(), strict=True)):
                        a, b = np.searchsorted(probe, np.uint64(g), "left"), np.searchsorted(probe, np.uint64(g), "right")
                        pairs.update((d, int(i)) for i in owner[a:b])
            sets: dict = {}
            items: dict = {}  # shingles of this slice's candidates only
            for d, i in sorted(pairs):
                k = self.lengths[i]
                if (d, k) not in sets:
                    sets[d, k] = _shingles(_word_lists(texts[lo + d].as_py()), k)
                if i not in items:
                    items[i] = _shingles(self.texts[i].split(b" "), k)
                shared = len(items[i] & sets[d, k])
                if shared >= self.share * self.sizes[i] - 1e-9:
                    yield ids[lo + d].as_py(), self.ids[i], self.sizes[i], shared, shared / self.sizes[i]


def find(docs: DataFrame, items: DataFrame, share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each document that contains an item.

    ``docs`` has doc_id and text, ``items`` has item_id and text. The items are read block by block
    by a local iterator, so the driver holds one block at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    target = docs.select("doc_id", "text")
    blocks, now, n = [], [], 0
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        if ws := _word_lists(r["text"]):
            now.append((r["item_id"], ws))
            n += len(ws)
            if n >= BLOCK_SHINGLES:
                blocks, now, n = [*blocks, _pass(target, now, share, shingle)], [], 0
    blocks.append(_pass(target, now, share, shingle))
    return reduce(DataFrame.unionAll, blocks)


def _pass(target: DataFrame, items: list, share: float, shingle: int) -> DataFrame:
    block = target.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Block(block.value, share, shingle)
        names = ["doc_id", "item_id", "item_shingles", "shared", "containment"]
        for batch in batches:
            found = list(ready.search(batch))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], names)

    return target.mapInArrow(search, SCHEMA)


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item; works row by row, without a join.

    The items are searched in blocks, so each block is a filter of its own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out, now, n = docs, [], 0
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        if ws := _word_lists(r["text"]):
            now.append((r["item_id"], ws))
            n += len(ws)
            if n >= BLOCK_SHINGLES:
                out, now, n = _filter(out, now, share, shingle), [], 0
    return _filter(out, now, share, shingle)


def _filter(docs: DataFrame, items: list, share: float, shingle: int) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Block(block.value, share, shingle)
        for batch in batches:
            rows = pa.array(np.arange(batch.num_rows))
            hit = {x[0] for x in ready.search(pa.RecordBatch.from_arrays([rows, batch.column(at)], ["row", "text"]))}
            yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(len(ws), 5) AS k, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(ws[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) WHERE len(ws) >= k)
)
SELECT doc_id::BIGINT AS doc_id, item_id::BIGINT AS item_id, n::BIGINT AS item_shingles, count(*)::BIGINT AS shared, count(*)::DOUBLE / n AS containment
FROM ds JOIN bs USING (k, s) JOIN bn USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""
