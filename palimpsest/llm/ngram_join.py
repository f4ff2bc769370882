"""N-gram Jaccard join: prefix filtering, rarest first, with length, positional and suffix filters.

1. Each text becomes its set of word n-grams; equal sets form one node, so copies are folded first.
2. A sketch of fixed size counts n-grams over all texts. It orders them: rare ones first, then by
   hash. Any order gives whole results; this one keeps frequent n-grams out of prefixes.
3. Two sets with the share t in common share an n-gram within their first n - ceil(t * n) + 1. Only
   n-grams that are in the prefixes of several nodes go on.
4. Round one pairs the nodes of an n-gram with one of them: as many pairs as prefix entries. The one
   is that whose n-grams are the most frequent on average, which in a group of near copies is the
   text they were made from. Round two pairs the others, but only nodes that round one has left in
   different components, so a large group of near copies isn't expanded into its pairs, while each
   pair that could join two components is looked at. Of a pair, the smaller set has to hold the
   n-gram in the shorter prefix that partners of its own size would need.
5. Pairs pass the length filter, the positional filter and a suffix filter (the overlap of two sets
   is at most the sum of the smaller counts over the parts of a hash partition), and are verified
   once, on the sets themselves.

A node is the 64-bit hash of a set; sets that share one are told apart by a second hash. Words are lower-cased (A-Z) runs outside white
space. A text with fewer words is one n-gram of all its words; one without words is linked with
nothing.

Defined cases: null or empty texts have size 0 and are components of their own; repeated rows share
node and component; null ids take part, and a component whose ids are all null has a null id;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .components import components
from .textkit import OTHER_KEY, bounded_batches, buffers, checkpoint, mix, shingle_sets, slices

SHINGLE = 4
PERCENT = 85
#: The frequency sketch: counters, in blocks that are summed apart.
COUNTERS = 1 << 20
_BLOCK = 1 << 14
#: Tasks' sketches are first added in so many groups.
FAN = 256
#: Parts of the suffix filter's partition.
PARTS = 64
#: Up to this many ids are broadcast to fetch texts; beyond, texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Hashes that different sets share; more than a few can't come about by chance.
MOST_CLASHES = 1000


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        h = mix(np.array([np.bitwise_xor.reduce(mix(s)) + np.add.reduce(s) * np.uint64(3) + np.uint64(len(s)), np.add.reduce(mix(s ^ np.uint64(OTHER_KEY))) + np.uint64(len(s))], np.uint64))
    first, second = h.view(np.int64).tolist()
    return first, second


def _node(s: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """The set's node: its first hash, or the second where different sets share the first."""
    first, second = _names(s)
    return second if first in clashes else first


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for lo, hi, data, off in slices(raw, offsets):
            yield batch, lo, hi, shingle_sets(data, off, k)


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, node, check, n, parts) for each row, and the frequency sketch in blocks (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "node", "check", "n", "parts", "block", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int16()), pa.int32(), pa.binary()]
        for batch, lo, hi, sets in _sets(batches, k):
            np.add.at(counts, _counter(np.concatenate([*sets, np.zeros(0, np.uint64)])), 1)
            parts = [np.minimum(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 32767).astype(np.int16) for s in sets]
            none = [None] * len(sets)
            both = [_names(s) for s in sets]
            cells = [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), [x for x, _ in both], [y for _, y in both], [len(s) for s in sets], parts, none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1)
            for b in range(COUNTERS // _BLOCK):
                cells = [[None], [None], [None], [None], [None], [b], [pack.compress(counts[b * _BLOCK : (b + 1) * _BLOCK].tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, check long, n int, parts array<short>, block int, counts binary")


def _frequencies(summaries: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed number of counters, whatever the input."""

    def add(t: pa.Table) -> pa.Table:
        total, unpack = np.zeros(_BLOCK, np.int64), zstandard.ZstdDecompressor()
        for c in t.column("counts"):
            total += np.frombuffer(unpack.decompress(c.as_py()), np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes())
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})

    # in two steps, so that no task reads the blocks of all tasks
    parts = summaries.where("block is not null").select("block", "counts", (F.spark_partition_id() % FAN).alias("fan"))
    some = parts.groupBy("block", "fan").applyInArrow(add, "block int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for r in some.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint32)
    return out


def _nodes(summaries: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """The rows with their nodes, the nodes (node, doc, n, parts), and the first hashes that different sets share.

    Different sets that share a 64-bit hash are told by the second one. They are as good as never met,
    so their list is held by the driver; it is refused where it isn't short, instead of being cut.
    """
    rows = summaries.where("block is null")
    gather = lambda x: checkpoint(x.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.min("check").alias("_lo"), F.max("check").alias("_hi")))
    nodes = gather(rows)
    met = [r["node"] for r in nodes.where("_lo <> _hi").select("node").limit(MOST_CLASHES + 1).collect()]
    if len(met) > MOST_CLASHES:
        raise ValueError("hashes of sets clash too often")
    if met:
        rows = rows.withColumn("node", F.when(F.col("node").isin(met), F.col("check")).otherwise(F.col("node")))
        nodes = gather(rows)
    return rows, nodes.drop("_lo", "_hi"), frozenset(met)


def _prefixes(docs: DataFrame, frequency: np.ndarray, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """(token, node, n, pos, often) for the prefix of each row's set; often: its n-grams' mean log frequency."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for _, _, _, sets in _sets(batches, k):
            tokens, nodes, sizes, at, means = [], [], [], [], []
            for s in sets:
                if n := len(s):
                    p = n - (percent * n + 99) // 100 + 1
                    f = often[_counter(s)]
                    tokens.append(s[np.lexsort((s, f))[:p]])
                    means.append(np.full(p, int(1000 * np.log2(f + 1.0).mean()), np.int32))
                    nodes.append(np.full(p, _node(s, clashes)))
                    sizes.append(np.full(p, n, np.int32))
                    at.append(np.arange(p, dtype=np.int32))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(nodes), np.concatenate(sizes), np.concatenate(at), np.concatenate(means)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n", "pos", "often"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, node long, n int, pos int, often int")


def _near(na: Column, nb: Column, percent: int) -> Column:
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap of two linked sets: 100 i >= percent (na + nb - i)."""
    return F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that pass the suffix filter."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("parts").alias(f"_p{x}"))
    joined = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    most = F.aggregate(F.zip_with("_pa", "_pb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    small = F.least("_na", "_nb") < 32767  # a part's count can't overflow
    return joined.where(_near(F.col("_na"), F.col("_nb"), percent) & (~small | (most >= _needed(F.col("_na"), F.col("_nb"), percent)))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """The pairs (a, b) whose sets, made from the texts again, reach the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    ids = checkpoint(wanted.join(nodes, "node").select("node", F.col("doc").alias("doc_id")))
    slim = docs.select("doc_id", "text")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = slim.join(near, slim["doc_id"].eqNullSafe(ids["doc_id"])).select("node", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=1)
        for batch, lo, _, sets in _sets(batches, k):
            rows = [(batch.column(0)[lo + i].as_py(), tight.compress(batch.column(1)[lo + i].as_py().encode())) for i, s in enumerate(sets) if len(s) and _node(s, clashes) == batch.column(0)[lo + i].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "packed"])

    # written, so that both sides of the joins are plain exchanges, whose large partitions Spark can split
    packed = checkpoint(texts.mapInArrow(pack, "node long, packed binary").dropDuplicates(["node"]))
    a, b = packed.select(F.col("node").alias("a"), F.col("packed").alias("_a")), packed.select(F.col("node").alias("b"), F.col("packed").alias("_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()

        def made(cell) -> np.ndarray:
            data = np.frombuffer(loose.decompress(cell.as_py()), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), k)[0]

        last, mine = None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                if (u := batch.column(0)[i].as_py()) != last:
                    last, mine = u, made(batch.column(2)[i])
                other = made(batch.column(3)[i])
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "_a", "_b").sortWithinPartitions("a")
    return checkpoint(rows.mapInArrow(verify, "a long, b long"))


def link(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) for each row of ``docs`` (doc_id, text).

    Components are whole; links within one are neither all found nor counted.
    """
    bounded_batches(docs.sparkSession)
    summaries = checkpoint(_summaries(docs, k))
    rows, nodes, clashes = _nodes(summaries)
    prefixes = checkpoint(_prefixes(docs, _frequencies(summaries), k, percent, clashes))

    ranged = prefixes.groupBy("token").agg(F.min("node").alias("_x"), F.max("node").alias("_y"), F.max(F.struct("often", "node"))["node"].alias("star")).where("_x < _y").select("token", "star")
    shared = checkpoint(prefixes.join(ranged, "token").select("token", "node", "n", "pos", "star").distinct())

    # round one: stars
    stars = shared.where("node <> star").select(F.col("star").alias("a"), F.col("node").alias("b"))
    first = checkpoint(_filtered(stars, nodes, percent))
    links = _verified(first, docs, nodes, k, percent, clashes)

    # round two: pairs of nodes that are not in one component yet
    label = checkpoint(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    marked = checkpoint(shared.join(label, "node", "left").select("token", "node", "n", "pos", F.coalesce("root", "node").alias("label")))
    # a pair's smaller set, a, needs the shared n-gram early enough for a partner of its own size: most frequent
    # n-grams stand behind that place wherever they are in a prefix, so they pair nothing
    early = F.col("n") - F.col("pos") >= _needed(F.col("n"), F.col("n"), percent)
    of = marked.withColumn("_early", early).groupBy("token")
    mixed = of.agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.max("_early").alias("_e"), F.min(F.when(F.col("_early"), F.col("n"))).alias("_least")).where("_x < _y and _e").select("token", "_least")
    # written, so that both sides of the self-join are plain exchanges, whose large partitions Spark can split
    open_ = checkpoint(marked.join(mixed, "token").where("n >= _least").drop("_least"))
    left, right = (open_.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "pos", "label")]) for side in "ab")
    left = left.where(F.col("n_a") - F.col("pos_a") >= _needed(F.col("n_a"), F.col("n_a"), percent))
    na, nb = F.col("n_a"), F.col("n_b")
    reach = F.least(na - F.col("pos_a"), nb - F.col("pos_b")) >= _needed(na, nb, percent)
    smaller = (na < nb) | (na == nb) & (F.col("node_a") < F.col("node_b"))
    cross = left.join(right, "token").where(smaller & (F.col("label_a") != F.col("label_b")) & _near(na, nb, percent) & reach)
    second = _filtered(cross.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")), nodes, percent)
    second = second.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _verified(checkpoint(second), docs, nodes, k, percent, clashes)

    root = label
    if more.limit(1).count():
        root = components(label.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    placed = nodes.select("node", "doc").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    by_node = checkpoint(placed.join(least, "root").select("node", "component_id"))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is their component's least (rows without id stay)."""
    linked = link(docs, k, percent)
    gone = checkpoint(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark, sf_dir):
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
