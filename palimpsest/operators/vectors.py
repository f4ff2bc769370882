"""Nearest vectors for stated queries: an exact scan by matrix products, and an index of inverted lists.

The index is fitted on a bounded sample (``SAMPLE`` vectors by a hash of their id) and holds every vector: its
list is that of the nearest centroid, its code what is left of it, in eight bits a component. A search ranks
the codes of the lists nearest to a query and compares the best of them exactly. How many lists are
read is chosen on the sample, as the fewest that reach the wanted recall there; the recall on all vectors is
measured against the exact scan by ``recall``.

Defined cases: a null, empty or zero vector, one with a null component or of another length than the query has
cosine 0; ids are passed on, ties go by the smaller one; an empty table or no queries give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ASKED, ROWS, Best
from .retrieval import top

#: Queries of one pass, a few hundred bytes each.
PASS = 5000
SAMPLE, LISTS, ROUNDS = 20_000, 64, 8
#: Candidates that are compared exactly for each one that is wanted.
AGAIN = 8
#: Recall that is wanted on the sample.
WANTED = 0.97
_FOUND = "query int, vec_id long, score double"


def units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in doubles; zeros for what isn't a vector of ``width`` components."""
    size = column.value_lengths().fill_null(-1).to_numpy()
    good = size == width
    if good.all() and not column.flatten().null_count:
        x = column.flatten().to_numpy().astype(float).reshape(-1, width)
    else:
        x = np.zeros((len(column), width))
        for i in np.flatnonzero(good):
            v = column[int(i)].as_py()
            if None not in v:
                x[i] = v
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1.0)[:, None]


def _passes(queries: DataFrame) -> Iterator[list]:
    block: list = []
    for r in queries.where("query is not null").select("query_id", "query").toLocalIterator():
        block.append(r)
        if len(block) == PASS:
            yield block
            block = []
    if block:
        yield block


def _gathered(parts: list[DataFrame], queries: DataFrame, k: int) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, vec_id long, score double, rank int")
    return top(reduce(DataFrame.unionAll, parts), "query_id", [F.desc("score"), F.asc("vec_id")], k)


def _named(found: DataFrame, block: list, queries: DataFrame) -> DataFrame:
    names = found.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "query").select("query_id", "vec_id", "score")  # one row a query of the pass


def exact_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest of all ``vectors`` (vec_id, embedding), by cosines of six places. Each task keeps ``k`` for a query."""
    slim, parts = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), []
    for block in _passes(queries):
        widths = sorted({len(r["query"]) for r in block})
        asked = {w: [i for i, r in enumerate(block) if len(r["query"]) == w] for w in widths}
        rows = {w: units(pa.array([block[i]["query"] for i in at], pa.list_(pa.float64())), w) for w, at in asked.items()}

        def run(batches: Iterator[pa.RecordBatch], asked=asked, rows=rows) -> Iterator[pa.RecordBatch]:
            best = Best(sum(map(len, asked.values())), k)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    ids = part.column(0).to_numpy()
                    for w, at in asked.items():
                        x = units(part.column(1), w)
                        for q in range(0, len(at), ASKED):
                            best.add(np.round(x @ rows[w][q : q + ASKED].T, 6) + 0.0, ids, np.array(at[q : q + ASKED]))
            yield best.batch(["query", "vec_id", "score"])

        parts.append(_named(slim.mapInArrow(run, _FOUND), block, queries))
    return _gathered(parts, queries, k)


class Lists:
    """An index under ``path``: ``codes`` (list, ids, codes, scale) and ``vectors`` (vec_id, embedding)."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, probes: int) -> None:
        self.spark, self.path, self.centroids, self.probes = spark, path.rstrip("/"), centroids, probes

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = LISTS, wanted: float = WANTED, k: int = 10) -> Lists:
        spark = vectors.sparkSession
        slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = slim.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()  # at most SAMPLE rows
        sizes = [len(r["embedding"]) for r in rows if r["embedding"]]
        width = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
        x = units(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width)
        x = x[np.abs(x).sum(1) > 0]
        centroids = _train(x, lists) if len(x) else np.eye(width)[:1]
        held = cls(spark, path, centroids, _tune(x, centroids, wanted, k) if len(x) else 1)
        slim.write.parquet(f"{held.path}/vectors")

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, v = batch.column(0).to_numpy(zero_copy_only=False), units(batch.column(1), width)
                own = (v @ centroids.T).argmax(1)
                rest = v - centroids[own]
                scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
                codes = np.round(rest / scale[:, None]).astype(np.int8)
                order = np.argsort(own, kind="stable")
                cuts = np.flatnonzero(np.diff(own[order])) + 1
                groups = np.split(order, cuts) if len(order) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own[g[0]]) for g in groups], pa.int32()), *[pa.array([z[g].tobytes() for g in groups], pa.binary()) for z in (ids.astype(np.int64), codes, scale)]], ["list", "ids", "codes", "scale"]
                )

        coded = held._read("vectors").where("vec_id is not null").mapInArrow(code, "list int, ids binary, codes binary, scale binary")
        coded.sortWithinPartitions("list").write.parquet(f"{held.path}/codes")
        return held

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank) as ``exact_top`` gives them, from the lists nearest to each query."""
        centroids, width, parts = self.centroids, self.centroids.shape[1], []
        for block in _passes(queries):
            q = units(pa.array([r["query"] for r in block], pa.list_(pa.float64())), width)
            near = q @ centroids.T
            read = np.argsort(-near, axis=1)[:, : probes or self.probes]
            asking = {int(c): np.flatnonzero((read == c).any(1)) for c in np.unique(read)}

            def run(batches: Iterator[pa.RecordBatch], q=q, near=near, asking=asking) -> Iterator[pa.RecordBatch]:
                best = Best(len(q), AGAIN * k)
                for batch in batches:
                    for n, *parts in zip(*(batch.column(x) for x in ("list", "ids", "codes", "scale")), strict=True):
                        n, (ids, codes, scale) = n.as_py(), (np.frombuffer(x.as_buffer(), t) for x, t in zip(parts, (np.int64, np.int8, float), strict=True))
                        codes = codes.reshape(len(ids), -1)
                        for lo in range(0, len(ids), ROWS):
                            x = codes[lo : lo + ROWS].astype(float) * scale[lo : lo + ROWS, None]
                            for c in range(0, len(asking[n]), ASKED):
                                at = asking[n][c : c + ASKED]
                                best.add(near[at, n] + x @ q[at].T, ids[lo : lo + ROWS], at)
                yield best.batch(["query", "vec_id", "score"])

            found = self._read("codes").where(F.col("list").isin(*asking)).mapInArrow(run, _FOUND)
            some = top(found, "query", [F.desc("score"), F.asc("vec_id")], AGAIN * k).select("query", "vec_id")

            def exact(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    s = np.einsum("ij,ij->i", units(batch.column(2), width), q[batch.column(0).to_numpy()])
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(s, 6) + 0.0)], ["query", "vec_id", "score"])

            again = some.join(self._read("vectors"), "vec_id").select("query", "vec_id", "embedding").mapInArrow(exact, _FOUND)
            parts.append(_named(again, block, queries))
        return _gathered(parts, queries, k)


def _train(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of the sample: Lloyd's iterations from every n-th vector, on the unit sphere."""
    c = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            s = x[own == j].sum(0)
            n = np.sqrt(s @ s)
            c[j] = s / n if n > 0 else c[j]
    return c


def _tune(x: np.ndarray, centroids: np.ndarray, wanted: float, k: int) -> int:
    """The fewest lists in which the sample's vectors find the wanted share of their ``k`` nearest in the sample."""
    asked = x[:: max(1, len(x) // 200)][:200]
    own = (x @ centroids.T).argmax(1)
    nearest = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # of each list among those nearest to the query
    needed = np.sort(np.take_along_axis(place, own[nearest], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): the share of the exact rows that were found, by id."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("_h", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("_h").alias("found"), F.round(F.count("_h") / F.count("*"), 4).alias("recall"))
