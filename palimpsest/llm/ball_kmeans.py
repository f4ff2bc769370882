"""Centroid clustering by ball k-means, exact in integers.

Each cluster is a ball around its centroid. Members know their distance to their own centroid; the
ball's radius is the largest of them. Another centroid can only win a member if it is a neighbour,
that is nearer to the ball's centre than twice the radius. A member whose doubled distance is below
that of the nearest neighbour centroid is in the stable core and keeps its cluster; the others lie in
annuli between the half distances to the neighbours, in order, and are compared exactly with the
neighbours their annulus reaches, and no others. Everything is compared in squared integers, so
the result is that of Lloyd's iterations, ties included.

The vectors are written once as integers, with their first assignment (compared with all
centroids); each round then reads them with their last assignment and writes the next. A task
gathers its own sums per cluster, so at most ``k`` rows of it reach the shuffle, however many vectors
share a cluster or are equal. Only centroids, ``k`` rows, are on the driver and sent to the tasks.

Defined cases: vectors of another length, with a null or non-finite component, or null themselves are
left out; a null id is passed on, and comes last in the choice of the first centroids; repeated ids
are vectors of their own, and among them the choice goes by components; fewer than ``k`` vectors start
as many clusters; an empty table gives an empty result; a component whose integer exceeds ``MOST`` in
size is an error, since squared distances would leave 64 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkit import sha, shared_dir

K, ROUNDS, SEED, SCALE = 40, 5, 2, 256
#: Largest integer component.
MOST = 1 << 27
_STATE = "vec_id long, v array<int>, cluster int, distance long"
_SUMS = "cluster int, n long, inertia long, part int, s long"


def integers(vectors: DataFrame, components: int) -> DataFrame:
    """(vec_id, v): floor(256 x) of each component of the vectors that are kept."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("_x")).where((F.size("_x") == components) & ~F.exists("_x", bad))
    whole = lambda c: F.when(F.abs(c * SCALE) <= MOST, F.floor(c * SCALE).cast("int")).otherwise(F.raise_error(F.lit("a component is out of range")).cast("int"))
    return kept.select("vec_id", F.transform("_x", whole).alias("v"))


def start_key(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one row or to rows, in 64-bit integers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance by comparison with every centroid; the smaller number wins a tie."""
    best, own = squares(x, centroids[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        d = squares(x, centroids[j])
        won = d < best
        best[won], own[won] = d[won], j
    return own, best


def reassign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and distance of vectors that were in clusters ``own``, and how many exact comparisons that took; ``apart``: squared distances of the centroids."""
    out, best = own.copy(), squares(x, centroids[own])
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(centroids) + 1))
    compared = len(x)
    for i in range(len(centroids)):
        members = order[cuts[i] : cuts[i + 1]]
        if not len(members):
            continue
        first = best[members]
        # neighbours of the ball, nearest first
        near = np.flatnonzero(apart[i] <= 4 * int(first.max()))
        near = near[near != i]
        near = near[np.argsort(apart[i][near], kind="stable")]
        # the annulus: how many neighbours a member's doubled distance reaches; none in the stable core
        reach = np.searchsorted(apart[i][near], 4 * first, "right")
        for t, j in enumerate(near):
            at = members[reach > t]
            if not len(at):
                break
            d = squares(x[at], centroids[j])
            compared += len(at)
            won = (d < best[at]) | (d == best[at]) & (j < out[at])
            best[at[won]], out[at[won]] = d[won], j
    return out, best, compared


def _components(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _assign(state: DataFrame, centroids: np.ndarray, first: bool) -> DataFrame:
    """The vectors with their cluster and distance."""
    shared = state.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        apart = np.stack([squares(c, x) for x in c])
        for batch in batches:
            x = _components(batch, c.shape[1])
            own, best = nearest(x, c) if first else reassign(x, batch.column(2).to_numpy().astype(np.int64), c, apart)[:2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(best)], ["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", *[] if first else ["cluster"]).mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[int], list[list[int]]]:
    """Members, inertia and sums of the components of each cluster. A task's sums are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = [0] * k, [0] * k
        total = [[0] * width for _ in range(k)]
        for batch in batches:
            x, own, d = _components(batch, width), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i in np.unique(own):
                at = own == i
                n[i] += int(at.sum())
                far[i] += int(d[at].sum())
                total[i] = [a + b for a, b in zip(total[i], x[at].sum(0).tolist(), strict=True)]
        held = [i for i in range(k) if n[i]]
        rows = [(i, n[i] if p == 0 else 0, far[i] if p == 0 else 0, p, total[i][p]) for i in held for p in range(width)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["cluster", "n", "inertia", "part", "s"])

    parts = state.mapInArrow(run, _SUMS).groupBy("cluster", "part").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "inertia", "s")])
    n, far, total = np.zeros(k, object), [0] * k, [[0] * width for _ in range(k)]
    for r in parts.collect():  # k * width rows
        i, p = r["cluster"], r["part"]
        n[i], far[i], total[i][p] = n[i] + int(r["n"]), far[i] + int(r["inertia"]), int(r["s"])
    return n, far, total


def cluster(vectors: DataFrame, components: int = 64, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/balls-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    state = written(integers(vectors, components), "integers", "vec_id long, v array<int>")
    chosen = state.orderBy(F.asc_nulls_last(start_key(F.col("vec_id"), seed)), "v").limit(k).select("v").collect()  # k vectors
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not chosen:
        return state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["v"] for r in chosen], np.int64)
    for turn in range(rounds + 1):
        state = written(_assign(state, centroids, first=turn == 0), f"round-{turn}", _STATE)
        n, far, total = _sums(state, len(centroids), components)
        if turn < rounds:
            centroids = np.array([[s // n[i] for s in total[i]] if n[i] else centroids[i].tolist() for i in range(len(centroids))], np.int64)
    rows = [(i, far[i], sum(far), sha(",".join(map(str, c)).encode())) for i, c in enumerate(centroids.tolist())]
    # a row for each centroid
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(spark.createDataFrame(rows, names)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Lloyd's iterations, round by round, as SQL."""
    ok = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    out = [f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {ok})"]
    out.append(f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INT AS cluster, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) <= {K})")
    for t in range(ROUNDS + 1):
        d = "list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"a{t} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(cluster, d * 100 + cluster) AS cluster, min(d) AS distance FROM (SELECT vec_id, kept.v AS v, cluster, {d} AS d FROM kept, c{t} c) GROUP BY vec_id)")
        if t < ROUNDS:
            floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
            out.append(
                f"m{t} AS (SELECT cluster, list({floor} ORDER BY i) AS v FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{t}) GROUP BY cluster, i) GROUP BY cluster), "
                f"c{t + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m ON m.cluster = c.cluster)"
            )
    last = ROUNDS
    return "WITH " + ", ".join(out) + (
        f" SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 "
        f"FROM a{last} a JOIN c{last} c ON c.cluster = a.cluster"
    )


SQL = _sql()
