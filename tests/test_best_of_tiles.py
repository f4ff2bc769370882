"""The best of each query is kept over tiles of rows and queries."""

import numpy as np
from palimpsest.operators.blocks import ASKED, ROWS, Best


def test_the_best_are_those_of_the_whole_table():
    rng = np.random.default_rng(1)
    scores = np.round(rng.normal(size=(3000, 700)), 1)  # many ties
    scores[:, 3], scores[5:, 4] = 0.0, -np.inf
    ids = rng.permutation(3000)
    best = Best(700, 10)
    for lo in range(0, 3000, ROWS):
        for q in range(0, 700, ASKED):
            best.add(scores[lo : lo + ROWS, q : q + ASKED], ids[lo : lo + ROWS], np.arange(q, min(700, q + ASKED)))
    got = best.batch(["q", "i", "s"]).to_pydict()
    rows = {}
    for q, i, s in zip(got["q"], got["i"], got["s"], strict=True):
        rows.setdefault(q, []).append((-s, i))
    for q in range(700):
        assert rows[q] == sorted((-s, i) for s, i in zip(scores[:, q], ids, strict=True) if s > -np.inf)[:10]
    assert Best(3, 0).batch(["q", "i", "s"]).num_rows == 0
