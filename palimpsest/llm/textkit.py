"""Shared kit: Arrow batches as byte arrays, vectorised word and n-gram hashes, shared-folder checkpoints.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``. Those separators never occur inside a
multi-byte UTF-8 sequence, so words can be cut on bytes. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Texts are handled in slices of about this many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Keys of two independent families of hashes; together they name a content by 128 bits.
KEY, OTHER_KEY = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises ``df`` as Parquet in the folder all executors share and reads it back.

    The folder is ``spark.checkpoint.dir``; only where that is unset (tests) a folder beside the
    warehouse is used. Unlike a local checkpoint it survives lost executors, and unlike an RDD
    checkpoint it is columnar and compressed.
    """
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the warehouse folder."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/palimpsest-tmp").rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keeps Arrow batches of texts small: rows can be long, and Spark's default takes 10,000 of them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, the first 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``most`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, data[a:b], offsets[lo : hi + 1] - a
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros beyond the end; one position more than bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(eight: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEY) -> np.ndarray:
    """64-bit hashes of byte ranges, from ``loads``: keyed mixes of all their eight-byte pieces, added up.

    Every piece goes through a bijective mixer with its place, so no structure of a text makes sums
    meet; ranges of one length up to eight bytes never share a hash.
    """
    size = ends - starts
    whole = _LOW[np.minimum(size, 8)]
    out = mix((eight[starts] & whole) + U64(key))
    long = np.flatnonzero(size > 8)
    if len(long):
        pieces = (size[long] + 7) // 8 - 1  # beyond the first
        head = np.cumsum(pieces) - pieces
        place = np.arange(int(pieces.sum())) - np.repeat(head, pieces) + 1
        at = np.repeat(starts[long], pieces) + 8 * place
        left = np.minimum(np.repeat(ends[long], pieces) - at, 8)
        out[long] += np.add.reduceat(mix((eight[at] & _LOW[left]) + (place + 1).astype(U64) * U64(key)), head)
    return mix(out + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None, check: bool = False) -> tuple[np.ndarray, ...]:
    """Starts, ends and 64-bit hashes of the words of some rows, and each row's first word (n + 1 offsets).

    ``breaks`` marks bytes, none of them a separator, that begin a word of their own. ``check`` adds
    hashes of a second, independent family.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        out = none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
        return (*out, np.zeros(0, U64)) if check else out
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    if breaks is not None:
        first |= breaks
        last[:-1] |= breaks[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = ~space[cut]
    last[cut - 1] = ~space[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    eight = loads(_LOWER[data] if lower else data)
    out = starts, ends, span_hashes(eight, starts, ends), np.searchsorted(starts, offsets)
    return (*out, span_hashes(eight, starts, ends, OTHER_KEY)) if check else out


def ngrams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-grams of a word sequence, and which of them lie within one row (row: words' offsets)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U64)
    for i in range(k):
        out += hashes[i : i + n] * U64(pow(_BASE, 2 * i + 1, 1 << 64))
    out = mix(out)
    end = np.repeat(row[1:], np.diff(row))[:n]
    return out, np.arange(n) + k <= end


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """Each row's distinct ``k``-word shingles as sorted hashes; the whole sequence where there are fewer words."""
    _, _, h, row = words(data, offsets, lower)
    grams, inside = ngrams(h, row, k)
    out = []
    for a, b in zip(row[:-1], row[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(ngrams(h[a:b], np.array([0, b - a]), b - a)[0] ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def windows(x: np.ndarray, length: int, step: int = 1, key: int = KEY) -> np.ndarray:
    """Hashes of all windows of ``length`` hashes that lie ``step`` apart: halves are joined by a keyed mixer.

    A window of a length between two powers of two is joined from two overlapping ones.
    """
    one, two = U64(key | 1), U64((key >> 7) | 1)
    size, now = 1, x
    while size < length:
        by = min(size, length - size)
        now = mix(now[: len(now) - by * step] * one + (now[by * step :] ^ two)) if len(now) > by * step else now[:0]
        size += by
    return now


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, one for each start; two running minima over blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
