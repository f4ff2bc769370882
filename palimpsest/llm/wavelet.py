"""Wavelet matrix of a token sequence: access, rank, select and counting on compressed bit-planes.

Plane by plane, from the most significant bit, the sequence is split stably into zeros and ones. A
plane is kept in chunks of ``CHUNK`` bits, each compressed on its own, and a directory holds the number
of ones before every chunk and where its bytes lie. A question reads the directory and unpacks only
the chunks it meets, about one a plane. One byte string holds everything.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"PWM2"
CHUNK = 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_HEAD = struct.Struct("<4sQII")


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], ranks: np.ndarray, load: Callable[[int, int], np.ndarray]) -> None:
        """zeros: each level's number of zeros; ranks: ones before each chunk of a level; load: a chunk's packed bits."""
        self.n, self.zeros, self.ranks, self.load = n, zeros, ranks, load
        self.seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        now, planes, zeros = np.asarray(ids, kind), [], []
        n, chunks = len(now), -(-len(now) // CHUNK)
        ranks = np.zeros((bits, chunks + 1), np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (now & kind(1 << level)) != 0
            if n:
                ranks[bits - 1 - level, 1:] = np.cumsum(np.add.reduceat(bit, np.arange(0, n, CHUNK), dtype=np.int64))
            planes.append(np.packbits(bit))
            ones = now[bit]
            zeros.append(n - len(ones))
            now = np.concatenate([now[~bit], ones]) if len(ones) else now
        return cls(n, zeros, ranks, lambda level, c: planes[level][c * (CHUNK // 8) : (c + 1) * (CHUNK // 8)])

    def _chunk(self, level: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's packed bits and the ones before each of its bytes."""
        if (level, c) not in self.seen:
            packed = self.load(level, c)
            self.seen[level, c] = packed, np.concatenate([[0], np.cumsum(_ONES[packed], dtype=np.int64)])
        return self.seen[level, c]

    def _by_chunk(self, at: np.ndarray):
        if not len(at):
            return
        c = np.minimum(at // CHUNK, max(0, self.ranks.shape[1] - 2))
        order = np.argsort(c, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(c[order]) > 0]))
        for a, b in zip(heads, [*heads[1:], len(c)], strict=True):
            yield int(c[order[a]]), order[a:b]

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        for c, rows in self._by_chunk(at):
            inner = at[rows] - c * CHUNK
            out[rows] = (self._chunk(level, c)[0][inner >> 3] >> (7 - (inner & 7)).astype(np.uint8)) & 1
        return out

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        if not self.n:
            return out
        for c, rows in self._by_chunk(at):
            packed, before = self._chunk(level, c)
            inner = at[rows] - c * CHUNK
            byte, part = inner >> 3, inner & 7
            last = packed[np.minimum(byte, len(packed) - 1)] >> (8 - part).astype(np.uint8)
            out[rows] = self.ranks[level, c] + before[byte] + np.where(part > 0, _ONES[np.where(part > 0, last, 0)], 0)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at = np.asarray(at, np.int64).copy()
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such position")
        out = np.zeros(len(at), np.uint32)
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, at)
            ones = self._rank1(level, at)
            at = np.where(bit, z + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def decode(self) -> np.ndarray:
        """All ids: the stable splits undone from the last plane to the first, in linear time."""
        levels = len(self.zeros)
        kind = np.uint16 if levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(levels - 1, -1, -1):
            z = self.zeros[level]
            if z == self.n:  # all zeros: nothing moves, nothing is set
                continue
            packed = np.concatenate([self.load(level, c) for c in range(self.ranks.shape[1] - 1)])
            bit = np.unpackbits(packed, count=self.n).view(bool)
            back = np.empty(self.n, kind)
            back[~bit] = out[:z]
            back[bit] = out[z:] | kind(1 << (levels - 1 - level))
            out = back
        return out.astype(np.uint32)

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        top = len(self.zeros)
        if symbol < 0 or symbol >> top:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, np.array([lo, hi]))
            lo, hi = (z + a, z + b) if (symbol >> (top - 1 - level)) & 1 else (lo - a, hi - b)
        return int(lo), int(hi)

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of ``symbol`` before ``end``."""
        return self.count(symbol, 0, end)

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, ks: np.ndarray) -> np.ndarray:
        """Positions of the ``ks``-th occurrences, counted from 0."""
        lo, hi = self._range(symbol, 0, self.n)
        at = lo + np.asarray(ks, np.int64)
        if len(at) and (at.min() < lo or at.max() >= hi):
            raise IndexError("no such occurrence")
        levels = len(self.zeros)
        for level in range(levels - 1, -1, -1):
            one = (symbol >> (levels - 1 - level)) & 1
            at = self._select_bit(level, at - self.zeros[level] * one, one)
        return at

    def _select_bit(self, level: int, k: np.ndarray, one: int) -> np.ndarray:
        """Positions of the ``k``-th ones (or zeros): the chunk by the directory, the place within it."""
        ones = self.ranks[level]
        before = ones if one else np.minimum(np.arange(len(ones)) * CHUNK, self.n) - ones
        c = np.searchsorted(before, k, "right") - 1
        out = np.zeros(len(k), np.int64)
        for u in np.unique(c).tolist():
            rows = np.flatnonzero(c == u)
            bits = np.unpackbits(self._chunk(level, u)[0], count=min(CHUNK, self.n - u * CHUNK))
            out[rows] = u * CHUNK + np.flatnonzero(bits == one)[k[rows] - before[u]]
        return out

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol)))

    def to_bytes(self) -> bytes:
        packer = zstandard.ZstdCompressor(level=1)
        levels, chunks = len(self.zeros), self.ranks.shape[1] - 1
        parts = [packer.compress(self.load(level, c).tobytes()) for level in range(levels) for c in range(chunks)]
        ends = np.cumsum([len(p) for p in parts], dtype="<u8")
        head = _HEAD.pack(MAGIC, self.n, levels, chunks) + np.array(self.zeros, "<u8").tobytes()
        return head + self.ranks.astype("<u8").tobytes() + ends.tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        """Reads the directory; chunks are unpacked when a question needs them."""
        magic, n, levels, chunks = _HEAD.unpack_from(raw) if len(raw) >= _HEAD.size else (b"", 0, 0, 0)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        numbers = np.frombuffer(raw, "<u8", levels * (2 + 2 * chunks), _HEAD.size).astype(np.int64)
        zeros, ranks, ends = numbers[:levels], numbers[levels : levels * (2 + chunks)].reshape(levels, chunks + 1), numbers[levels * (2 + chunks) :]
        data, unpacker = _HEAD.size + 8 * len(numbers), zstandard.ZstdDecompressor()

        def load(level: int, c: int) -> np.ndarray:
            i = level * chunks + c
            a = data + (int(ends[i - 1]) if i else 0)
            return np.frombuffer(unpacker.decompress(raw[a : data + int(ends[i])], max_output_size=CHUNK // 8), np.uint8)

        return cls(n, zeros.tolist(), ranks, load)
