"""Language identification by a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that overlap by one less than the widest
filter, so every run of bytes is seen whole. Filters of 2, 3 and 4 bytes slide over a window; each
filter's largest response is kept (max pooling); a softmax over the languages reads these maxima. A
text's probabilities are the means of its windows', weighted by their bytes. Since the input is one of
256 bytes at each place, a filter is a table of weights for each of its places, and a convolution
is a sum of looked-up rows; for scoring, the tables of two neighbouring places are added up beforehand.

Training (Adagrad on the cross-entropy; the gradient passes to each filter's winning place) takes about
``TRAIN_DOCS`` labelled documents for each language at most, and at most ``TRAIN_WINDOWS`` windows in all, chosen by
hashes; the bounds are parameters. It runs on the driver, on windows that tasks have cut; scoring
passes over all texts in Arrow batches, without a shuffle. Language, source and id are never inputs.

Letters are folded before: A-Z, and the capitals of the Latin-1 block in UTF-8.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows
every text is ``und``; with one language it is that one; repeated rows score alike; null ids are passed
on and never learnt from; very long texts are cut into as many windows as they need, a bounded number
at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .fm_classifier import held_out
from .textkit import bounded_batches, buffers, slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
TRAIN_DOCS = 1500
TRAIN_WINDOWS = 8000
EPOCHS = 6
SEED = 11
#: Windows that are scored at a time: some MB of responses.
CHUNK = 64
UNKNOWN = "und"
_PAD = max(WIDTHS) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and, after 0xC3, the capitals À to Þ in lower case."""
    out = _FOLD[data]
    if len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 32
    return out


def windows(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes that are the window's own, WINDOW + 3 bytes) of the windows of some texts, zeros beyond a text's end; at most ``most`` at a time."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    first = np.cumsum(many) - many
    total = int(many.sum())
    for lo in range(0, total, most):
        k = np.arange(lo, min(lo + most, total))
        row = np.searchsorted(first, k, "right") - 1  # rows without bytes share their successor's first, which is found
        start = offsets[row] + (k - first[row]) * WINDOW
        place = start[:, None] + np.arange(WINDOW + _PAD)
        out = data[np.minimum(place, len(data) - 1)]
        out[place >= offsets[row + 1][:, None]] = 0
        yield row, np.minimum(offsets[row + 1] - start, WINDOW), out


class Network:
    """Tables [width][place][byte][filter], the maxima's weights [language][feature] and biases."""

    def __init__(self, languages: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(languages), FILTERS * len(WIDTHS))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.pairs: list[list[np.ndarray]] | None = None

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """What the filters of each width say at each place of the windows: (windows, WINDOW, FILTERS)."""
        if self.pairs is None:
            return [sum(t[k][x[:, k : k + WINDOW]] for k in range(w)) for w, t in zip(WIDTHS, self.tables, strict=True)]
        two = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for w, t in zip(WIDTHS, self.pairs, strict=True):
            r = np.take(t[0], two[:, :WINDOW], axis=0)
            if w > 2:  # a third byte alone, or a second pair
                r += np.take(t[1], two[:, 2 : 2 + WINDOW] if w == 4 else x[:, 2 : 2 + WINDOW], axis=0)
            out.append(r)
        return out

    def ready(self) -> Network:
        """With the tables of neighbouring places added up, for scoring."""
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.pairs = [[two(t[0], t[1]), *([t[2]] if len(t) == 3 else [two(t[2], t[3])] if len(t) == 4 else [])] for t in self.tables]
        return self

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out.T + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        parts = [self.softmax(np.concatenate([r.max(1) for r in self.responses(x[lo : lo + CHUNK])], 1)) for lo in range(0, len(x), CHUNK)]
        return np.concatenate([np.zeros((0, len(self.languages)), np.float32), *parts])

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each text; zeros for one without bytes."""
        sums, low = np.zeros((len(offsets) - 1, len(self.languages))), folded(data)
        for row, size, x in windows(low, offsets):
            np.add.at(sums, row, self.predict(x) * size[:, None])
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-300)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.1, batch: int = 32) -> Network:
    """Trains on windows ``x`` and their languages' numbers ``y``."""
    net, rng = Network(languages), np.random.default_rng(SEED)
    if len(languages) < 2 or not len(x):
        return net
    past = [[np.full_like(t, 1e-2) for t in ts] for ts in net.tables]
    past_out, past_bias = np.full_like(net.out, 1e-2), np.full_like(net.bias, 1e-2)
    filters = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            xs = x[at]
            said = net.responses(xs)
            winner = [r.argmax(1) for r in said]
            pooled = np.concatenate([np.take_along_axis(r, i[:, None], 1)[:, 0] for r, i in zip(said, winner, strict=True)], 1)
            error = net.softmax(pooled)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back, grad, flat = error @ net.out, error.T @ pooled, error.sum(0)
            past_out += grad**2
            past_bias += flat**2
            net.out -= rate * grad / np.sqrt(past_out)
            net.bias -= rate * flat / np.sqrt(past_bias)
            for k, (w, i) in enumerate(zip(WIDTHS, winner, strict=True)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for p in range(w):
                    byte = xs[np.arange(len(at))[:, None], i + p]  # at the winning place, for each window and filter
                    change = np.zeros_like(net.tables[k][p])
                    np.add.at(change, (byte, filters[None]), g)
                    past[k][p] += change**2
                    net.tables[k][p] -= rate * change / np.sqrt(past[k][p])
    return net


def examples(docs: DataFrame, per_language: int = TRAIN_DOCS, most: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, their languages' numbers and the languages: of rows with a text, an id and a language that are not held out.

    Languages get equal shares of ``most``; a language's documents and their windows are chosen by hashes.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(counts)
    share = max(1, most // max(1, len(languages)))
    # ids whose hash is below their language's share of rows, so no language's rows meet in one task
    limits = [(x, min(1 << 30, math.ceil((1 << 30) * min(per_language, share) / n))) for x, n in counts.items()]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, _most long")
    chosen = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.col("_most")).select("doc_id", "lang").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for lo, hi, data, off in slices(raw, offsets):
                for row, size, x in windows(folded(data), off):
                    # short rests are left out, unless they are all of a text
                    keep = np.flatnonzero((size >= 64) | (np.diff(off)[row] <= WINDOW))
                    langs = batch.column(0).slice(lo, hi - lo).take(pa.array(row[keep]))
                    yield pa.RecordBatch.from_arrays([langs, pa.array([x[i].tobytes() for i in keep], pa.binary())], ["lang", "w"])

    # about ``most`` ids, or one for each language
    made = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(cut, "lang string, w binary")
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("w", F.lit(SEED)), "w")
    got = made.withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= share).select("lang", "w").collect()
    got.sort(key=lambda r: (r["w"], r["lang"]))
    number = {x: i for i, x in enumerate(languages)}
    x = np.frombuffer(b"".join(r["w"] for r in got), np.uint8).reshape(-1, WINDOW + _PAD)
    return x, np.array([number[r["lang"]] for r in got], np.int64), languages


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, most: int = TRAIN_WINDOWS) -> Network:
    bounded_batches(docs.sparkSession)
    return fit(*examples(docs, per_language, most))


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value.ready()
        names = [*net.languages, UNKNOWN]
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            p = np.concatenate([np.zeros((0, len(net.languages))), *[net.texts(data, off) for _, _, data, off in slices(raw, offsets)]]) if net.languages else np.zeros((batch.num_rows, 0))
            known = batch.column(2).to_numpy(zero_copy_only=False) & (p.shape[1] > 0)
            best = np.where(known, p.argmax(1) if p.shape[1] else 0, len(net.languages))
            score = np.where(known, p.max(1, initial=0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter.alias("_letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
