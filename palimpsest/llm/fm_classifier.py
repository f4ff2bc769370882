"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct hashed words (each with weight one over the root of their
number), one bin for each structure statistic of its text, and one for its recorded length. The
machine scores them as w0 + sum w x + 1/2 (|sum v x|^2 - sum |v x|^2): all pairwise interactions in
time linear in the features. It is trained here, on the driver, by Adagrad over at most
``TRAIN_ROWS`` labelled rows and ``TRAIN_BYTES`` of features (chosen by a hash of their id; the bounds
are parameters); scoring passes over all documents in Arrow batches, without a shuffle. Language, source, id and labels are
never features.

Defined cases: a null or empty text has no words and scores by its structure bins; a null length has
a bin of its own; repeated rows score alike; without labelled rows of both classes every score is
the share of label 1 (0.5 without any); labels that are null are not learnt from; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkit import bounded_batches, buffers, checkpoint, slices, words

WORD_BITS = 15
RANK = 8
TRAIN_ROWS = 8000
#: Bytes of features that are learnt from at most: rows are taken in the order of a hash of their id until they are reached.
TRAIN_BYTES = 256 << 20
EPOCHS = 8
SEED = 7
STRUCTURE_WEIGHT = 0.5
_BINS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
STATS = ("symbols", "upper", "digits", "exclaims", "stops", "word_size", "distinct", "adjacent", "lines", "n_words", "top_word", "n_chars")
SIZE = (1 << WORD_BITS) + _BINS * len(STATS)
#: Shares fall in bins by these edges.
_EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.23, 0.32, 0.45, 0.6, 0.78, 0.95])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def featurize(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, weights and row offsets of a slice of texts; ``n_chars`` is NaN where unknown."""
    n = len(offsets) - 1
    _, _, h, row = words(data, offsets)
    count = np.diff(row).astype(float)
    doc = np.repeat(np.arange(n), np.diff(row))
    # distinct words of each row, and how often the most frequent one occurs
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    fresh = np.ones(len(hs), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    heads = np.flatnonzero(fresh)
    runs = np.diff(np.concatenate([heads, [len(hs)]]))
    distinct = np.bincount(ds[heads], minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, ds[heads], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    share = lambda x, of: x / np.maximum(of, 1)
    chars = np.diff(offsets).astype(float)
    letters = _per_row(_LETTER[data], offsets)
    log = lambda x: np.where(np.isnan(x), _BINS - 1, np.minimum(np.log2(np.maximum(np.nan_to_num(x), 0) + 1), _BINS - 2))
    bins = lambda x: np.searchsorted(_EDGES, x, "left")
    stats = [
        bins(share(_per_row(_SYMBOL[data], offsets), chars)),
        bins(share(_per_row(_UPPER[data], offsets), letters)),
        bins(share(_per_row(_DIGIT[data], offsets), chars)),
        bins(share(_per_row(data == 33, offsets), count)),
        bins(share(_per_row(_STOP[data], offsets), count)),
        np.minimum(share(chars, count), _BINS - 1),
        bins(share(distinct, count)),
        bins(share(np.bincount(doc[same], minlength=n), count)),
        bins(share(_per_row(data == 10, offsets), count)),
        log(count),
        bins(share(top, count)),
        log(n_chars),
    ]
    word_ids = (hs[heads] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    ids = np.concatenate([word_ids, *[(1 << WORD_BITS) + _BINS * k + np.asarray(s, np.int64) for k, s in enumerate(stats)]])
    rows = np.concatenate([ds[heads], *[np.arange(n)] * len(stats)])
    weights = np.concatenate([1 / np.sqrt(np.maximum(distinct, 1))[ds[heads]], np.full(n * len(stats), STRUCTURE_WEIGHT)])
    order = np.argsort(rows, kind="stable")
    return ids[order], weights[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v

    def raw(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; every row has at least its structure features."""
        if len(rows) == 1:
            return np.zeros(0)
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, rows[:-1])
        squares = np.add.reduceat((vx**2).sum(1), rows[:-1])
        return self.bias + np.add.reduceat(self.w[ids] * x, rows[:-1]) + 0.5 * ((s**2).sum(1) - squares)

    def score(self, *features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features), -30, 30)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-5, batch: int = 64) -> Machine:
    """Trains on (feature ids, weights, label) by Adagrad on the logistic loss."""
    rng = np.random.default_rng(SEED)
    share = float(np.mean([y for *_, y in examples])) if examples else 0.5
    bias = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
    m = Machine(bias, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if share in (0.0, 1.0) or not examples:
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), batch):
            part = [examples[i] for i in order[lo : lo + batch]]
            ids, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            sizes = np.array([len(p[0]) for p in part])
            rows = np.concatenate([[0], np.cumsum(sizes)])
            error = m.score(ids, x, rows) - np.array([p[2] for p in part])
            e = np.repeat(error, sizes) * x / len(part)
            vx = m.v[ids] * x[:, None]
            s = np.repeat(np.add.reduceat(vx, rows[:-1]), sizes, axis=0)
            uniq, at = np.unique(ids, return_inverse=True)
            dw = np.bincount(at, e) + decay * m.w[uniq]
            dv = np.stack([np.bincount(at, e * (s[:, f] - vx[:, f])) for f in range(RANK)], 1) + decay * m.v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            gb += error.mean() ** 2
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * 0.5 * dv / np.sqrt(gv[uniq])
            m.bias -= rate * 0.2 * error.mean() / np.sqrt(gb)
    return m


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _batch_features(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    text, chars = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("n_chars"))
    raw, offsets = buffers(text)
    known = chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for lo, hi, data, off in slices(raw, offsets):
        yield lo, hi, featurize(data, off, known[lo:hi])


def examples(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most ``rows`` labelled, not held-out documents as features, in a fixed order; of rows that share an id, one."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, (ids, x, at) in _batch_features(batch):
                cells = [(ids[at[i] : at[i + 1]].astype(np.int32).tobytes(), x[at[i] : at[i + 1]].astype(np.float32).tobytes()) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo).cast(pa.int32()), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())],
                    ["doc_id", "y", "ids", "x"],
                )

    slim = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", "text", "n_chars")
    made = slim.mapInArrow(features, "doc_id long, y int, ids binary, x binary")
    # one row an id, however often it occurs
    once = checkpoint(made.groupBy("doc_id").agg(F.min(F.struct("ids", "x", "y")).alias("_f")).select("doc_id", "_f.*"))
    sizes = once.select("doc_id", F.length("ids").alias("n"), F.xxhash64("doc_id", F.lit(SEED)).alias("h")).collect()
    sizes.sort(key=lambda r: (r["h"], r["doc_id"]))
    total, last = 0, None
    for r in sizes:
        total += 3 * r["n"]
        if total > TRAIN_BYTES:
            break
        last = r
    if last is None:
        return []
    h = F.xxhash64("doc_id", F.lit(SEED))
    got = once.where((h < last["h"]) | (h == last["h"]) & (F.col("doc_id") <= last["doc_id"])).collect()
    got.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), int(r["y"])) for r in got]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    bounded_batches(docs.sparkSession)
    return fit(examples(_with_chars(docs), labels, label, rows))


def _with_chars(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.length("text").cast("long"))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text and, if there, n_chars)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for batch in batches:
            scores = [m.score(*f) for _, _, f in _batch_features(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate([*scores, np.zeros(0)]).astype(float))], ["doc_id", "score"])

    return _with_chars(docs).select("doc_id", "text", "n_chars").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``least`` or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    own = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            import pyarrow.compute as pc

            chars = batch.column(batch.schema.get_field_index("n_chars")) if own else pc.utf8_length(text).cast(pa.int64())
            slim = pa.RecordBatch.from_arrays([text, chars], ["text", "n_chars"])
            scores = np.concatenate([*[m.score(*f) for _, _, f in _batch_features(slim)], np.zeros(0)])
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
