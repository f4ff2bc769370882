"""Substring removal by words with recompression.

Two rounds name pairs of symbols: a hash of a symbol's name says whether it may stand left or right,
and a left symbol before a right one becomes one symbol, named by a hash of both names. Names are
contents' hashes, so every task and every document gives the same pair the same name, without an
exchange. Equal symbols never pair, so a run of one word stays a run of equal names, whose first
place is taken in ties. A symbol of round two spans one to four words, and whether it arises depends
on three words to each side at most: within a 13-word window, symbols that keep that distance from
its ends are the same wherever the window occurs. The one with the least name is the window's anchor.

Anchors with the three words to each side are the shared symbols that reveal repeats (see
``repeats``). Where contents differ around one anchor, the windows themselves are named (anchor and
window, 64 bits each) and their least document is found by aggregation, so a frequent passage is
pre-aggregated before it is shuffled and its joins can be split.

Words are runs outside ``\\x20\\x09-\\x0D``, unchanged; windows are judged on the input. A very long
text is looked at in overlapping pieces of about 1 MB.

Defined cases: a null or empty text has no words and keeps the empty string; repeated rows are
documents of their own (see ``repeats.numbered``), so later ones lose all windows; fewer than 13
words are never removed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .repeats import Blocks, covered, names, numbered, repeated_runs, text_buffers, with_runs
from .textkit import KEY, OTHER_KEY, SLICE_BYTES, U64, mix, sliding_min, windows, words

LENGTH = 13
ROUNDS = 2
#: Words to each side that decide whether a symbol of the last round arises; its own most words.
REACH = (1 << ROUNDS) - 1
WIDEST = 1 << ROUNDS
_PLACE = U64((1 << 27) - 1)  # of a slice or piece
_TOP = np.iinfo(np.uint64).max


def compress(names: np.ndarray, starts: np.ndarray, row: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over symbols (names, first words, rows): pairs of a left and a right symbol become one."""
    side = (mix(names + U64(round_ + 1)) >> U64(17)) & U64(1)
    pair = np.zeros(len(names), bool)
    pair[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (row[:-1] == row[1:])
    stays = np.ones(len(names), bool)
    stays[1:] = ~pair[:-1]
    out = names.copy()
    at = np.flatnonzero(pair)
    out[at] = mix(names[at] * U64(0xD6E8FEB86659FD93) + mix(names[at + 1]) + U64(round_ + 1))
    return out[stays], starts[stays], row[stays]


def _scheme(data: np.ndarray, offsets: np.ndarray) -> Blocks:
    _, _, h, first, check = words(data, offsets, check=True)
    n = len(h)
    none = np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + LENGTH <= end)
    if not len(at):
        return none, none, none, *[none.astype(U64)] * 3
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names, starts, row = h, np.arange(n), row_of
    for r in range(ROUNDS):
        names, starts, row = compress(names, starts, row, r)
    span = np.diff(np.concatenate([starts, [n]]))
    # the least name among the symbols within each window's safe part, by the symbols' spans
    best = np.full(n - LENGTH + 1, _TOP, np.uint64)
    for width in range(1, WIDEST + 1):
        value = np.full(n, _TOP, np.uint64)
        mine = span == width
        value[starts[mine]] = (names[mine] & ~_PLACE) | starts[mine].astype(U64)
        inner = LENGTH - 2 * REACH - width + 1
        best = np.minimum(best, sliding_min(value, inner)[REACH : REACH + len(best)])
    anchor = (best[at] & _PLACE).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.concatenate([heads, [len(at)]]))
    lo, a = at[heads], anchor[heads]
    width = span[np.searchsorted(starts, a)]
    # ranges of words are named by two windows that overlap: a symbol with its surroundings, and the whole block
    near = windows(h, 2 * REACH + 1)
    key = mix(near[a - REACH] * U64(KEY) + near[a + width - REACH - 1] + width.astype(U64))
    place = (count * 64 + a - lo).astype(U64)
    whole, second = windows(h, LENGTH), windows(check, LENGTH, key=OTHER_KEY)
    ctx = mix(whole[lo] * U64(KEY) + whole[lo + count - 1] + place)
    other = mix(second[lo] * U64(OTHER_KEY) + second[lo + count - 1] + place)
    rows = row_of[lo]
    return rows, lo - first[rows], count, key, ctx, other


def _pieces(data: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of about ``size`` bytes, cut between words, each with the twelve words that follow it."""
    lo, base = 0, 0
    while lo < len(data):
        to, step = lo + size, 1 << 16
        while to < len(data):  # the next blank
            gap = np.flatnonzero(np.isin(data[to : to + step], _SEPARATORS))
            if len(gap):
                to += int(gap[0])
                break
            to, step = to + step, step * 2
        to = min(to, len(data))
        more, reach = 0, 1 << 12
        while to < len(data):  # the end of the twelfth word after the piece
            _, ends, _, _ = words(data[to : to + reach], np.array([0, min(reach, len(data) - to)]))
            if len(ends) > LENGTH or to + reach >= len(data):
                more = int(ends[min(LENGTH - 2, len(ends) - 1)]) if len(ends) else 0
                break
            reach *= 2
        yield base, data[lo : to + more]
        base += len(words(data[lo:to], np.array([0, to - lo]))[0])
        lo = to


def _windows(data: np.ndarray, offsets: np.ndarray):
    _, _, _, first, check = words(data, offsets, check=True)
    second = windows(check, LENGTH, key=OTHER_KEY)
    return first, lambda at: second[at]


def _opened(blocks: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    named = names(ask(blocks), _windows)
    least = named.groupBy("anchor", "name").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).where("_first < _last").drop("_last")
    return named.join(least, ["anchor", "name"]).where("doc > _first").select("doc", "at", F.lit(1).alias("count"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row; ``kept`` is the remaining text."""
    rows = numbered(docs)
    runs = repeated_runs(rows, _scheme, _pieces, _opened, within=False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                data = raw[offsets[i] : offsets[i + 1]].tobytes()
                ws, entries = data.translate(_BLANKS).split(), batch.column(2)[i].as_py()
                n, gone = len(ws), 0
                if entries:
                    mark = covered(entries, LENGTH, n)
                    gone = int(mark.sum())
                    ws = [w for w, m in zip(ws, mark.tolist(), strict=True) if not m]
                kept = b" ".join(ws)
                out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept string"
    return with_runs(rows, runs).select("doc_id", "text", "entries").mapInArrow(cut, schema)


_SEPARATORS = np.array([0x20, *range(0x09, 0x0E)], np.uint8)
#: bytes.split() cuts at exactly the six separators once they are spaces.
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def query(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
