"""Tables that are folded as they grow: latest rows, partial sums.

A fold takes rows to rows of the same columns, and folding parts first changes nothing (the latest row of a
key, sums and extremes by key). Each batch is folded, written, and made visible by a commit; ``FANOUT``
folders of a level are folded to one of the next. So a read folds a few folders, whose number follows the
logarithm of the batches, and not the history. A batch that comes again, by its number, has no effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Commits
from .state import latest

FANOUT = 4


def latest_rows(key: str, order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The fold that keeps the last row of each key."""
    return lambda rows: latest(rows, key, order)


def sums(key: str, **kinds: str) -> Callable[[DataFrame], DataFrame]:
    """The fold that keeps a row for each key, its columns by sum, min or max."""
    return lambda rows: rows.groupBy(key).agg(*[getattr(F, how)(c).alias(c) for c, how in kinds.items()])


class Folded:
    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.schema, self.fold = spark, path.rstrip("/"), schema, fold
        self.commits = Commits(spark, f"{self.path}/commits")

    def _read(self, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f['name']}" for f in folders])

    def _write(self, rows: DataFrame, level: int) -> dict:
        name = f"part-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        self.fold(rows).select(*columns).write.parquet(f"{self.path}/{name}")
        return {"name": name, "level": level}

    def folders(self) -> list[dict]:
        return self.commits.latest()[1].get("folders", [])

    def add(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Adds a batch; False, without effect, if its number isn't above that of the last one."""
        if batch is not None and batch <= self.commits.latest()[1].get("last", -1):
            return False
        made, added = self._write(rows, 0), True

        def step(now: dict) -> dict | None:
            nonlocal added
            added = batch is None or batch > now.get("last", -1)
            if not added:
                return None
            return {**now, "folders": [*now.get("folders", []), made], **({} if batch is None else {"last": batch})}

        self.commits.change(step)
        if not added:
            self.commits.remove(f"{self.path}/{made['name']}")
        self.compact()
        return added

    def compact(self, everything: bool = False) -> None:
        """Folds the folders of each full level to one. The old ones stay on disk for readers under way."""
        while True:
            done = True

            def step(now: dict) -> dict | None:
                nonlocal done
                held = now.get("folders", [])
                full = [x for x in sorted({f["level"] for f in held}) if sum(f["level"] == x for f in held) >= FANOUT]
                done = not full or everything
                if not (full or everything and len(held) > 1):
                    return None
                level = max(f["level"] for f in held) if everything else full[0]
                old = [f for f in held if everything or f["level"] == level]
                return {**now, "folders": [*(f for f in held if f not in old), self._write(self._read(old), level + 1)]}

            self.commits.change(step)
            if done:
                return

    def read(self) -> DataFrame:
        return self.fold(self._read(self.folders()))
