"""A stated query set against all rows, block by block."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of one block, which every task gets: with vectors or texts of a few KB, some MB.
BLOCK = 2000
#: Rows and queries that are scored at a time in a task: a table of scores has some MB, whatever is asked.
ROWS, ASKED = 1024, 512


class Best:
    """The ``k`` largest scores of each query over the rows that a task meets, smaller ids first."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        """Scores of rows (``ids``) by ``queries``."""
        if not self.scores.shape[1]:
            return
        reached = scores >= self.scores[queries, -1]
        for c in np.flatnonzero(reached.any(0)):
            q, rows = queries[c], np.flatnonzero(reached[:, c])
            rows = rows[(scores[rows, c] > self.scores[q, -1]) | (ids[rows] < self.ids[q, -1])]
            if len(rows):
                s, x = np.concatenate([self.scores[q], scores[rows, c]]), np.concatenate([self.ids[q], ids[rows]])
                keep = np.lexsort((x, -s))[: self.scores.shape[1]]
                self.scores[q], self.ids[q] = s[keep], x[keep]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """(query, id, score)."""
        q, at = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(self.ids[q, at]), pa.array(self.scores[q, at])], names)


def against(rows: DataFrame, queries: DataFrame, most: int = BLOCK) -> DataFrame:
    """Every pair of a row and a stated query. The queries are counted; beyond ``most`` they go in blocks, one pass over the rows each."""
    blocks = -(-queries.count() // most)
    if blocks <= 1:
        return rows.crossJoin(F.broadcast(queries))
    # twice as many, since hashing fills blocks unevenly
    dealt = F.pmod(F.xxhash64(*queries.columns), F.lit(2 * blocks))
    return reduce(DataFrame.unionAll, [rows.crossJoin(F.broadcast(queries.where(dealt == i))) for i in range(2 * blocks)])
