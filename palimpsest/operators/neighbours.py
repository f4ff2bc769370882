"""Exact similarity join and nearest neighbours of vectors (cosine), by cells around pivots and bounds on prefixes.

A bounded sample gives pivots and a rotation; they change the work, never the result. Every vector goes
to the cell of its nearest pivot, and a cell is a cap: its pivot and the largest angle of a member. Angles
obey the triangle inequality, so two cells can hold a similar pair only if their pivots are at most the sum
of both radii and the threshold's angle apart; other pairs of cells are never brought together. Cells are
cut to tiles of about ``TILE`` vectors by a hash, so a cell that holds a third of all rows is many tasks.

Within a pair of tiles the product of the leading components, after the rotation, plus the product of
what is left of both lengths bounds the cosine (Cauchy and Schwarz). Pairs whose bound falls short on
the first 16, 32, 48 components are out; the rest are compared exactly, and counted.

Defined cases: a null, empty or zero vector, one with a null or non-finite component or of another length than
most has cosine 0 with everything; rows without an id are left out; groups of null are compared like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

PIVOTS, SAMPLE, TILE = 32, 2000, 1024
STEPS = (16, 32, 48)
#: Pairs that are compared exactly at a time: two tiles have up to a million, with two vectors each.
EXACT = 1 << 14
#: What rounding may add to an angle or a cosine.
SLACK = 1e-7
_DEALT = "id long, grp string, cell int, angle double, v binary"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of float64 vectors that are stored as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors; zeros for what isn't a vector of ``width`` finite components."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column.to_pylist()):
        if x is not None and len(x) == width and None not in x:
            v = np.array(x, float)
            n = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
            if n > 0 and math.isfinite(n):
                out[i] = v / n
    return out


class Space:
    """Pivots and rotation of a collection of vectors (id, embedding)."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> None:
        rows = vectors.where("id is not null and embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()  # at most ``sample`` rows
        sizes = [len(r["embedding"]) for r in rows if r["embedding"]]
        self.width = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
        x = _units(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), self.width)
        x = x[np.abs(x).sum(1) > 0]
        # the directions with most weight first, so that prefixes say most
        self.turn = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy() if len(x) else np.eye(self.width)
        x = x @ self.turn
        chosen = [0] if len(x) else []
        while chosen and len(chosen) < min(pivots, len(x)):  # the one farthest from all so far
            near = (x @ x[chosen].T).max(1)
            if near.min() > 1 - 1e-9:
                break
            chosen.append(int(near.argmin()))
        self.pivots = x[chosen] if chosen else np.eye(self.width)[:1]
        self.apart = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1))

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))


def _dealt(vectors: DataFrame, space: Space) -> DataFrame:
    """(id, grp, cell, angle, v) of vectors (id, grp, embedding): turned unit vectors with their cell."""

    def run(batches):
        for batch in batches:
            x = _units(batch.column(2), space.width) @ space.turn
            a = space.angles(x)
            cell = a.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(x)), cell]), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "grp", "cell", "angle", "v"])

    rows = vectors.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("grp").cast("string"), F.lit("\0")).alias("grp"), F.col("embedding").cast("array<double>").alias("embedding"))
    return checkpoint(rows.mapInArrow(run, _DEALT))


def _cells(dealt: DataFrame) -> DataFrame:
    """(grp, cell, radius, tiles)."""
    return dealt.groupBy("grp", "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))


def _tiled(dealt: DataFrame, cells: DataFrame) -> DataFrame:
    return dealt.join(cells.select("grp", "cell", "tiles"), ["grp", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).drop("tiles", "angle")


def similar(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` whose bound reaches ``need`` (for each row of ``x``), and their exact cosines."""
    left = np.ones((len(x), len(y)), bool)
    for m in STEPS:
        if m >= x.shape[1] or left.mean() < 0.02:
            break
        rest = [np.sqrt(np.maximum((z[:, m:] ** 2).sum(1), 0)) for z in (x, y)]
        left &= x[:, :m] @ y[:, :m].T + rest[0][:, None] * rest[1][None] >= need[:, None] - SLACK
    i, j = np.nonzero(left)
    s = np.zeros(len(i))
    for lo in range(0, len(i), EXACT):
        at = slice(lo, lo + EXACT)
        s[at] = np.einsum("ij,ij->i", x[i[at]], y[j[at]])
    return i, j, s


_KEY = ["grp", "c1", "t1", "c2", "t2"]


def pairs(vectors: DataFrame, least: float, space: Space | None = None, counted: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: every pair within a group whose cosine is ``least`` (above 0) or more. Each pair of tiles that may hold one is a task of its own.

    ``counted`` gives (compared) instead: how many pairs were compared exactly, by pairs of tiles.
    """
    space = space or Space(vectors)
    dealt = _dealt(vectors.select("id", "grp", "embedding"), space)
    cells = checkpoint(_cells(dealt))
    theta = math.acos(min(1.0, least)) + SLACK
    spark = vectors.sparkSession
    apart = spark.createDataFrame([(i, j, float(space.apart[i, j])) for i in range(len(space.pivots)) for j in range(i, len(space.pivots))], "c1 int, c2 int, apart double")
    one, two = (cells.select("grp", F.col("cell").alias(f"c{k}"), F.col("radius").alias(f"r{k}"), F.col("tiles").alias(f"n{k}")) for k in (1, 2))
    met = one.join(F.broadcast(apart), "c1").join(two, ["grp", "c2"]).where(F.col("apart") <= F.col("r1") + F.col("r2") + theta)
    met = met.withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    met = met.where((F.col("c1") < F.col("c2")) | (F.col("t1") <= F.col("t2"))).select(_KEY)
    tiled = _tiled(dealt, cells)
    sides = [met.join(tiled.select("grp", F.col("cell").alias(f"c{k}"), F.col("tile").alias(f"t{k}"), "id", "v"), ["grp", f"c{k}", f"t{k}"]).select(*_KEY, "id", "v") for k in (1, 2)]
    width = space.width

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("id"), right.sort_by("id")  # a tile meets itself in one order
        ids = [t.column("id").to_numpy() for t in (left, right)]
        x, y = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        own = left.num_rows and right.num_rows and left.column("c1")[0] == left.column("c2")[0] and left.column("t1")[0] == left.column("t2")[0]
        i, j, s = similar(x, y, np.full(len(x), least))
        if own:
            i, j, s = (z[i < j] for z in (i, j, s))
        if counted:
            return pa.table({"compared": pa.array([len(i)], pa.int64())})
        i, j, s = (z[(s >= least - 1e-12) & (ids[0][i] != ids[1][j])] for z in (i, j, s))
        a, b = ids[0][i], ids[1][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    schema = "compared long" if counted else "a long, b long, similarity double"
    other = sides[1].toDF(*[f"_{k}" for k in _KEY], "id", "v")  # columns of its own
    return sides[0].groupBy(_KEY).cogroup(other.groupBy([f"_{k}" for k in _KEY])).applyInArrow(compare, schema)


def nearest(new: DataFrame, held: DataFrame, also: float = 0.85) -> DataFrame:
    """(new_id, grp, best_id, similarity, reached): for each of ``new`` the most similar of ``held`` in its group (six places; the smallest id of equal ones), and how many reach ``also``.

    First each new vector is compared with its own cell, which gives a similarity that is surely reached.
    Then only with the cells whose cap may hold one as near, or one that reaches ``also``.
    """
    space = Space(held)
    there = _dealt(held.select("id", "grp", "embedding"), space)
    cells = checkpoint(_cells(there))
    tiled = checkpoint(_tiled(there, cells).withColumnsRenamed({"id": "held_id", "v": "w"}))
    asked = _dealt(new.select("id", "grp", "embedding"), space)
    width = space.width

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, other = left.column("id").to_numpy(), right.column("held_id").to_numpy()
        out = {"id": [], "grp": [], "s": [], "n": [], "reached": []}
        order = np.argsort(other, kind="stable")
        y, other = _matrix(right.column("w"), width)[order], other[order]
        for lo in range(0, len(ids), TILE):
            part = left.slice(lo, TILE)
            x = _matrix(part.column("v"), width)
            i, j, s = similar(x, y, np.minimum(part.column("need").to_numpy(), also) - 1e-6)
            s = np.round(s, 6) + 0.0
            for k in np.unique(i):
                mine = np.flatnonzero(i == k)
                first = mine[np.argmax(s[mine])]  # ids ascend
                out["id"].append(int(ids[lo + k]))
                out["grp"].append(part.column("grp")[int(k)].as_py())
                out["s"].append(float(s[first]))
                out["n"].append(-int(other[j[first]]))
                out["reached"].append(int((s[mine] >= also).sum()))
        return pa.table([pa.array(out["id"], pa.int64()), pa.array(out["grp"], pa.string()), pa.array(out["s"], pa.float64()), pa.array(out["n"], pa.int64()), pa.array(out["reached"], pa.int64())], list(out))

    def met(rows: DataFrame) -> DataFrame:
        """Best and count over what the rows (id, grp, v, need, cell, tile) are brought together with."""
        keys = ["grp", "cell", "tile"]
        got = rows.groupBy(keys).cogroup(tiled.groupBy(keys)).applyInArrow(compare, "id long, grp string, s double, n long, reached long")
        return got.groupBy("id", "grp").agg(F.max(F.struct("s", "n")).alias("_m"), F.sum("reached").alias("reached"))

    spread = lambda df: df.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own = spread(asked.join(cells.select("grp", "cell", "tiles"), ["grp", "cell"])).select("id", "grp", "v", F.lit(-1.0).alias("need"), "cell", "tile")
    first = checkpoint(met(own).select("id", "grp", F.col("_m.s").alias("need")))
    known = asked.join(first, ["id", "grp"], "left").withColumn("need", F.coalesce("need", F.lit(-1.0)))

    def angles(batches):
        for batch in batches:
            a = space.angles(_matrix(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(list(a), pa.list_(pa.float64()))], ["id", "grp", "need", "angles"])

    far = known.select("id", "grp", "v", "need").mapInArrow(angles, "id long, grp string, need double, angles array<double>")
    far = far.select("id", "grp", "need", F.posexplode("angles").alias("cell", "angle")).join(cells, ["grp", "cell"])
    most = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius") - SLACK))  # of any member of the cap
    far = spread(far.where(most >= F.least("need", F.lit(also)) - 2e-6)).select("id", "grp", "cell", "tile")
    rows = far.join(known.select("id", "grp", "v", "need"), ["id", "grp"]).select("id", "grp", "v", "need", "cell", "tile")
    grp = F.when(F.col("grp") == "\0", F.lit(None)).otherwise(F.col("grp"))
    return met(rows).select(F.col("id").alias("new_id"), grp.alias("grp"), (-F.col("_m.n")).alias("best_id"), F.col("_m.s").alias("similarity"), "reached")
