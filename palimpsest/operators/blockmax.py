"""Top-k search over stored postings that skips blocks: by their bounds, and within them by queries.

A message's score is a sum of weights of the asked tokens it holds, times or over something that grows
with its length or norm. A block knows which asked tokens it holds and its least length or norm, hence
the most that any of its messages can score for a query. The blocks of the largest bounds are
scored first and give each query a threshold; then those blocks are scored whose bound reaches it for
some query. A search of more tokens than a scan can be told reads all postings in any case, so there all blocks
are scored at once. A block is scored as a whole, a bounded group of Arrow rows, for the queries that its bound
doesn't rule out: tokens that many of them ask for by a product of matrices, the others pair by pair.

The queries are a stated set: their tokens are collected, in passes of about ``PASS_ROWS``. Several ways of
scoring share a pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint
from . import index as stored
from .index import Index, Snapshot, flat
from .retrieval import top

PASS_ROWS = 100_000
#: Blocks of the largest bounds that set a query's first threshold.
FIRST = 2
#: Up to so many blocks (some 100,000 to 250,000 messages) all are scored at once: bounds and a first round would take longer than they save.
FEW = 128
K1, B = 1.2, 0.75
_OUT = pa.schema([("way", pa.int32()), ("query", pa.int32()), ("msg_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())])
_OUT_SQL = "way int, query int, msg_id long, score double, hits long"
#: Queries that are scored at a time in a block.
TILE = 256
#: Queries of a tile from which a token's are scored by a product.
SHARED = 8


@dataclass
class Way:
    """How sums of the weights of asked tokens become scores."""

    #: Numbers of messages that hold the tokens -> weights; None: each weighs 1, and those numbers aren't needed
    weigh: Callable[[np.ndarray], np.ndarray] | None
    #: (sums of queries by messages, lengths or norms of messages, the queries, their tokens' summed weights) -> scores, falling in the second
    finish: Callable
    #: Places the scores are rounded to, and the least that counts.
    places: int
    floor: float
    #: By norms, not lengths.
    norms: bool = False
    #: Only messages that hold all tokens of a query.
    every: bool = False


@dataclass
class Scored:
    """A way for the queries of a pass."""

    way: Way
    weight: np.ndarray
    #: Of each query's tokens.
    total: np.ndarray
    #: How many tokens a message must hold for each query; 1 to take all.
    need: np.ndarray

    def scores(self, sums: np.ndarray, values: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return self.way.finish(sums, values, self.total[queries])

    def reach(self, best: np.ndarray) -> np.ndarray:
        """The most that rounding can make of a bound."""
        return best + 10.0**-self.way.places


@dataclass
class Plan:
    """The queries of a pass and each one's tokens, and the ways they are scored."""

    ids: list
    tokens: list[str]
    first: np.ndarray
    token: np.ndarray
    ways: list[Scored]

    def rows(self, queries: np.ndarray) -> np.ndarray:
        """Places of the queries' tokens."""
        size = self.first[queries + 1] - self.first[queries]
        return np.repeat(self.first[queries] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def bounds(self, way: Scored, present: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each query: tokens that are ``present``, and the most that a message of at least this length or norm can score."""
        sums = np.add.reduceat(np.where(present[self.token], way.weight, 0.0), self.first[:-1])
        return np.add.reduceat(present[self.token].astype(np.int64), self.first[:-1]), way.scores(sums[:, None], np.array([least]), np.arange(len(self.ids)))[:, 0]


def _tile(plan: Plan, part: np.ndarray, column: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hits, and each way's sums, of queries (rows) by the ``n`` messages of a block (columns), from postings (token ``row``, message ``at``)."""
    pairs = plan.rows(part)
    query = np.repeat(np.arange(len(part)), plan.first[part + 1] - plan.first[part])
    order = np.argsort(column[pairs], kind="stable")
    order = order[np.searchsorted(column[pairs][order], 0) :]  # tokens of the block, by their place
    pairs, query = pairs[order], query[order]
    asking = np.bincount(column[pairs], minlength=row.max() + 1)
    start = np.cumsum(asking) - asking
    # pair by pair
    some = np.flatnonzero((asking[row] > 0) & (asking[row] < SHARED))
    size = asking[row[some]]
    pair = np.repeat(start[row[some]] - np.cumsum(size) + size, size) + np.arange(size.sum())
    key = query[pair] * n + np.repeat(at[some], size)
    # by a product
    often = np.flatnonzero(asking >= SHARED)
    place = np.full(len(asking), -1)
    place[often] = np.arange(len(often))
    some = np.flatnonzero(place[row] >= 0)
    grid = np.zeros((len(often), n))
    grid[place[row[some]], at[some]] = 1.0
    shared = np.flatnonzero(place[column[pairs]] >= 0)

    def sums(weight: np.ndarray | None) -> np.ndarray:
        out = np.bincount(key, None if weight is None else weight[pairs[pair]], len(part) * n).reshape(len(part), n)
        if not len(often):
            return out
        asked = np.zeros((len(part), len(often)))
        asked[query[shared], place[column[pairs[shared]]]] = 1.0 if weight is None else weight[pairs[shared]]
        return out + asked @ grid

    hits = sums(None)
    return hits, [hits if w.way.weigh is None else sums(w.weight) for w in plan.ways]


def _block(plan: Plan, group: pa.Table, floors: list[np.ndarray], k: int | None) -> pa.Table:
    """The messages of a block that reach their floor in a way, at most ``k`` for each query."""
    held = group.filter(pc.is_valid(group.column("token")))
    flat_ids, size = flat(held.column("ids"), np.int64)
    got = []
    if len(flat_ids):
        ids, at = np.unique(flat_ids, return_inverse=True)
        lengths = np.zeros(len(ids))
        lengths[at] = flat(held.column("values"), np.int32)[0]
        values = {False: lengths}
        if any(w.way.norms for w in plan.ways):  # the row of the norms: it holds all messages of the block, by id
            own = group.filter(pc.is_null(group.column("token")))
            values[True] = flat(own.column("values"), np.float64)[0][np.searchsorted(flat(own.column("ids"), np.int64)[0], ids)]
        number = {t: i for i, t in enumerate(plan.tokens)}
        place = np.full(len(plan.tokens), -1)
        place[[number[t] for t in held.column("token").to_pylist()]] = np.arange(len(held))
        column, row = place[plan.token], np.repeat(np.arange(len(held)), size)
        # what no message of the block can reach is left out
        open_ = np.zeros((len(plan.ways), len(plan.ids)), bool)
        for w, (way, floor) in enumerate(zip(plan.ways, floors, strict=True)):
            counts, best = plan.bounds(way, place >= 0, values[way.way.norms].min())
            open_[w] = (counts >= way.need) & (counts > 0) & (way.reach(best) >= floor)
        asked = np.flatnonzero(open_.any(0))
        for lo in range(0, len(asked), TILE):
            part = asked[lo : lo + TILE]
            hits, sums = _tile(plan, part, column, row, at, len(ids))
            for w, way in enumerate(plan.ways):
                scores = np.round(way.scores(sums[w], values[way.way.norms], part), way.way.places)
                for c in np.flatnonzero(open_[w][part]):
                    q = part[c]
                    rows = np.flatnonzero((hits[c] >= way.need[q]) & (scores[c] >= floors[w][q]))
                    if k is not None and len(rows) > k:
                        found = scores[c][rows]
                        rows = rows[found >= np.partition(found, len(rows) - k)[len(rows) - k]]
                        rows = rows[np.lexsort((ids[rows], -scores[c][rows]))[:k]]
                    got.append((np.full(len(rows), w), np.full(len(rows), q), ids[rows], scores[c][rows], hits[c][rows]))
    columns = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [[]] * 5
    return pa.table([pa.array(np.asarray(c), f.type, safe=False) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _score(rows: DataFrame, plan: Plan, floors: list[np.ndarray], k: int | None) -> DataFrame:
    """(way, query, msg_id, score, hits) of posting rows (block, token, ids, values), block by block."""
    return rows.select("block", "token", "ids", "values").groupBy("block").applyInArrow(lambda group: _block(plan, group, floors, k), _OUT_SQL)


def _search(rows: DataFrame, plan: Plan, k: int) -> DataFrame:
    """The ``k`` best of (block, token, least, ids, values) by one way, in two rounds."""
    spark, [way] = rows.sparkSession, plan.ways
    order, floor = [F.desc("score"), F.asc("msg_id")], way.way.floor

    def bound(group: pa.Table) -> pa.Table:
        p = plan
        number = {t: i for i, t in enumerate(p.tokens)}
        present = np.zeros(len(p.tokens), bool)
        present[[number[t] for t in group.column("token").to_pylist() if t is not None]] = True
        counts, best = p.bounds(way, present, group.column("least").to_numpy().min())
        at = np.flatnonzero((counts > 0) & (way.reach(best) >= floor))
        return pa.table({"block": pa.array(np.full(len(at), group.column("block")[0].as_py()), pa.int64()), "query": pa.array(at, pa.int32()), "bound": pa.array(best[at], pa.float64())})

    # the lists themselves are not read for the bounds
    bounds = checkpoint(rows.select("block", "token", "least").groupBy("block").applyInArrow(bound, "block long, query int, bound double"))
    least = np.full(len(plan.ids), floor)
    early = top(bounds, "query", [F.desc("bound"), "block"], FIRST).select("block").distinct()
    first = top(_score(rows.join(early, "block", "left_semi"), plan, [least], k), "query", order, k)
    for r in first.where(F.col("rank") == k).select("query", "score").collect():  # a row for each query of the pass
        least[r["query"]] = max(floor, r["score"])
    limits = spark.createDataFrame([(i, float(x)) for i, x in enumerate(least)], "query int, _l double")
    chosen = bounds.join(F.broadcast(limits), "query").where(F.col("bound") + 10.0**-way.way.places >= F.col("_l")).select("block").distinct()
    return top(_score(rows.join(chosen, "block", "left_semi"), plan, [least], k), "query", order, k)


def _passes(asked: DataFrame, run: Callable[[list], DataFrame]) -> DataFrame:
    """``run`` over the rows (query_id, token) of each pass."""
    some = asked.select("query_id", "token").distinct().limit(PASS_ROWS + 1).collect()
    if len(some) <= PASS_ROWS:
        return run(some)
    n = -(-asked.count() // PASS_ROWS)
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return reduce(DataFrame.unionAll, [run(asked.where(dealt == i).select("query_id", "token").distinct().collect()) for i in range(n)])


def _plan(rows: list, ways: list[Way], frequencies: Callable[[list[str]], np.ndarray]) -> Plan:
    queries = sorted({r["query_id"] for r in rows})
    tokens = sorted({r["token"] for r in rows})
    number, place = {q: i for i, q in enumerate(queries)}, {t: i for i, t in enumerate(tokens)}
    pairs = sorted((number[r["query_id"]], place[r["token"]]) for r in rows)
    query, token = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    size = np.bincount(query, minlength=len(queries))
    first = np.concatenate([[0], np.cumsum(size)])
    df = frequencies(tokens) if any(w.weigh for w in ways) else None
    scored = []
    for way in ways:
        weight = (way.weigh(df) if way.weigh else np.ones(len(tokens)))[token]
        scored.append(Scored(way, weight, np.add.reduceat(weight, first[:-1]), size if way.every else np.ones(len(queries), np.int64)))
    return Plan(queries, tokens, first, token, scored)


def _named(found: DataFrame, plan: Plan, id_type: str) -> DataFrame:
    names = found.sparkSession.createDataFrame(list(enumerate(plan.ids)), f"query int, query_id {id_type}")
    return found.join(F.broadcast(names), "query").drop("query")


def _frequencies(lists: DataFrame, tokens: list[str]) -> np.ndarray:
    df = {r["token"]: r["df"] for r in lists.groupBy("token").agg(F.sum("n").alias("df")).collect()}  # the asked tokens
    return np.array([df.get(t, 0) for t in tokens], float)


def search(index: Index | Snapshot, asked: DataFrame, ways: list[Way], k: int | None) -> DataFrame:
    """The ``k`` best messages of each query by each of several ways, all of them without a ``k``: (way, query_id, msg_id, hits, score, rank)."""
    kind = asked.schema["query_id"].dataType.simpleString()
    index = index.snapshot()

    def run(rows: list) -> DataFrame:
        if not rows:
            return asked.sparkSession.createDataFrame([], f"way int, query_id {kind}, msg_id long, hits long, score double, rank int")
        tokens = sorted({r["token"] for r in rows})
        held = index.live(index.segments, tokens)
        plan = _plan(rows, ways, lambda ts: _frequencies(held, ts))

        def lists(norms: bool) -> DataFrame:
            out = held.select("block", "token", F.col("least").cast("double").alias("least"), "ids", F.col("lengths").alias("values"))
            if not norms:
                return out
            own = index.norms().select("block", F.lit(None).cast("string").alias("token"), "least", "ids", F.col("norms").alias("values"))
            return out.withColumn("least", F.lit(float("inf"))).unionAll(own)

        # with tokens by which no row group is skipped, bounds and a first round would read everything again
        if k is None or index.most_blocks() <= FEW or len(tokens) > stored.NAMED:
            found = _score(lists(any(w.norms for w in ways)), plan, [np.full(len(plan.ids), w.floor) for w in ways], k)
            order = [F.desc("score"), F.asc("msg_id")]
            found = found.withColumn("rank", F.lit(None).cast("int")) if k is None else top(found, ["way", "query"], order, k)
        else:
            each = [_search(lists(s.way.norms), replace(plan, ways=[s]), k).withColumn("way", F.lit(n)) for n, s in enumerate(plan.ways)]
            found = reduce(DataFrame.unionByName, each)
        return _named(found, plan, kind).select("way", "query_id", "msg_id", "hits", "score", "rank")

    return _passes(asked, run)


def by_bm25(index: Snapshot, k1: float = K1, b: float = B) -> Way:
    n, total = index.totals()
    mean = total / n if n else 1.0
    weigh = lambda df: np.maximum(np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1e-300)), 1e-6)
    return Way(weigh, lambda s, dl, _: s * ((k1 + 1) / (1 + k1 * (1 - b + b * dl / mean))), 6, 0.0)


def by_count(every: bool = False) -> Way:
    return Way(None, lambda s, dl, _: s + 0 * dl, 0, 1.0, every=every)


def by_cosine(index: Snapshot, least: float = 0.05) -> Way:
    n, _ = index.totals()
    weigh = lambda df: np.where(df > 0, (np.log((n + 1) / (df + 1)) + 1) ** 2, 0.0)  # noqa: E731  a token of no message is no part of the query's norm
    return Way(weigh, lambda s, norm, total: s / (norm * np.sqrt(np.maximum(total, 1e-300))[:, None]), 3, np.nextafter(least, 1.0), norms=True)


def bm25(index: Index | Snapshot, asked: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 over token sets, rounded to six places: (query_id, msg_id, hits, score, rank)."""
    index = index.snapshot()
    return search(index, asked, [by_bm25(index, k1, b)], k).drop("way")


def count_match(index: Index | Snapshot, asked: DataFrame, k: int = 10) -> DataFrame:
    """Messages by the number of distinct query tokens they hold: (query_id, msg_id, hits, rank)."""
    return search(index, asked, [by_count()], k).drop("way", "score")


def match_all(index: Index | Snapshot, asked: DataFrame) -> DataFrame:
    """Messages that hold every token of a query: (query_id, msg_id, hits)."""
    return search(index, asked, [by_count(every=True)], None).select("query_id", "msg_id", "hits")


def tfidf_cosine(index: Index | Snapshot, asked: DataFrame, k: int = 10, least: float = 0.05) -> DataFrame:
    """Cosine of set vectors weighted by ln((N + 1) / (df + 1)) + 1, above ``least``, rounded to three places: (query_id, msg_id, hits, score, rank)."""
    index = index.snapshot()
    return search(index, asked, [by_cosine(index, least)], k).drop("way")
