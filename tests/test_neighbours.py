"""Exact similarity join, nearest neighbours and fingerprint search against plain comparison of all pairs."""

import numpy as np
import pytest

from palimpsest.operators import memory, neighbours, sketches

VECTORS = "id long, grp string, embedding array<float>"


def made(seed, n=260, width=32, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, width))
    x = (centres[rng.integers(0, 9, n)] + rng.normal(0, noise, (n, width))).astype(np.float32)
    x[40:60] = x[40]
    rows = [(i, "ab"[i % 2], [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [1.0] * (width - 1), [None] * width]
    return rows + [(1000 + k, "a", v) for k, v in enumerate(odd)] + [(None, "a", rows[0][2])]


def cos(a, b, width=32):
    ok = lambda v: v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v) and any(v)
    if not (ok(a) and ok(b)):
        return 0.0
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


@pytest.mark.parametrize("least,tile", [(0.8, 16), (0.5, 1024), (0.97, 7)])
def test_pairs_equal_all_comparisons(spark, monkeypatch, least, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rows = made(1)
    got = {(r.a, r.b): r.similarity for r in neighbours.pairs(spark.createDataFrame(rows, VECTORS), least).collect()}
    held = [r for r in rows if r[0] is not None]
    want = {(a[0], b[0]): c for a in held for b in held if a[0] < b[0] and a[1] == b[1] and (c := cos(a[2], b[2])) >= least}
    assert set(got) == set(want) and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_few_pairs_are_compared_exactly(spark):
    rows = made(2, 600, 64, 0.4)
    df = spark.createDataFrame(rows, VECTORS)
    compared = neighbours.pairs(df, 0.8, counted=True).agg({"compared": "sum"}).first()[0]
    assert compared < 0.1 * 2 * 300 * 300 / 2 + neighbours.pairs(df, 0.8).count()


def test_nearest_equals_all_comparisons(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    rows = [r for r in made(3) if r[0] is not None]
    new, held = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    got = {r.new_id: (r.best_id, r.similarity, r.reached) for r in neighbours.nearest(spark.createDataFrame(new, VECTORS), spark.createDataFrame(held, VECTORS)).collect()}
    for i, g, v in new:
        s = [(-round(cos(v, w), 6), j) for j, h, w in held if h == g]
        best = min(s)
        assert got[i] == (best[1], pytest.approx(-best[0], abs=1.1e-6), sum(-x >= 0.85 for x, _ in s)), i


def test_empty_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(made(4, 80), VECTORS)
    assert neighbours.pairs(none, 0.8).count() == 0
    assert neighbours.nearest(none, some).count() == neighbours.nearest(some, none).count() == 0


def test_consolidated_leaders_follow_the_order_of_ids(spark):
    rows = [r for r in made(5) if r[0] is not None]
    got = {r.node: r.leader for r in memory.consolidate(spark.createDataFrame(rows, "memory_id long, type string, embedding array<float>"), 0.7).collect()}
    leaders, want = [], {}
    for i, g, v in sorted(rows, key=lambda r: r[0]):
        near = [j for j, h, w in leaders if h == g and cos(v, w) >= 0.7]
        want[i] = min(near) if near else i
        if not near:
            leaders.append((i, g, v))
    assert got == want


def flipped(x, bits, rng):
    for b in rng.choice(128, bits, replace=False):
        x ^= 1 << int(b)
    return x


@pytest.mark.parametrize("most", [40, 55])
def test_near_prints_equal_a_plain_scan(spark, most):
    rng = np.random.default_rng(9)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    prints = [(i, flipped(base[i % 30], int(rng.integers(0, 60)), rng)) for i in range(400)] + [(400 + i, base[0]) for i in range(15)]
    asked = [(q, flipped(base[q], 3 * q, rng)) for q in range(12)] + [(90, int.from_bytes(rng.bytes(16), "big"))]
    p = spark.createDataFrame([(i, f"{x:032x}") for i, x in prints] + [(999, None)], "msg_id long, simhash string")
    q = spark.createDataFrame([(i, f"{x:032x}") for i, x in asked] + [(91, None)], "query_id long, query string")
    found = sketches.near(p, q, most)
    got = sorted((r.query_id, r["rank"], r.msg_id, r.distance) for r in found.collect())
    want = []
    for j, y in asked:
        near = sorted((bin(x ^ y).count("1"), i) for i, x in prints if bin(x ^ y).count("1") <= most)[:10]
        want += [(j, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    assert sketches.near(p.limit(0), q, most).count() == sketches.near(p, q.limit(0), most).count() == 0
