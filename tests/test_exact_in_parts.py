"""Two full tiles whose pairs all pass the bounds are compared in little memory."""

import tracemalloc

import numpy as np
from palimpsest.operators import neighbours


def test_pairs_of_full_tiles_are_compared_in_parts():
    rng = np.random.default_rng(2)
    x, y = (z / np.sqrt((z * z).sum(1))[:, None] for z in rng.normal(size=(2, neighbours.TILE, 64)))
    tracemalloc.start()
    i, j, s = neighbours.similar(x, y, np.full(len(x), -1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == len(x) * len(y) and np.allclose(s, (x @ y.T)[i, j])
    assert peak < 200 << 20
