"""Suffix arrays by induced sorting, in array operations, and permuted common prefixes.

Suffixes are classified, the leftmost smaller ones (LMS) are sorted by their substrings with two
induction passes, named, sorted recursively, and the whole array is induced from them in linear time.
An induction pass goes bucket by bucket; within a bucket a step handles all entries that are known so
far, so a pass takes as many steps as there are symbols plus the longest run of one symbol. A reduced
string of names is sorted in the same way, recursively; one whose alphabet is large against itself
would take a step for each of its symbols, so there the recursion ends and ranks are doubled.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which a reduced string is sorted by recursion.
SYMBOLS = 4096
#: By the bytes of a symbol: the least value of the bits of each but the first symbol of a piece.
_BITS = {n: np.array([1 << (8 * n * i) for i in range(1, 8 // n)], np.uint64) for n in (1, 2)}


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last suffix is larger (L) than the empty one."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _deal(sa: np.ndarray, j: np.ndarray, ch: np.ndarray, place: np.ndarray, sign: int) -> None:
    """Appends positions ``j`` to their symbols' buckets, in order, at and after ``place`` (or before it)."""
    if not len(j):
        return
    order = np.argsort(ch, kind="stable")
    ch, j = ch[order], j[order]
    heads = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(ch)]]))
    rank = np.arange(len(ch)) - np.repeat(heads, sizes)
    sa[place[ch] + rank if sign > 0 else place[ch] - 1 - rank] = j
    place[ch[heads]] += sign * sizes


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from the given order of the LMS suffixes."""
    n, k = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    ends = starts[1:].copy()
    _deal(sa, lms[::-1], t[lms[::-1]], ends, -1)
    head = starts[:-1].copy()

    def put(entries: np.ndarray, small: bool, place: np.ndarray) -> None:
        j = entries - 1
        j = j[j >= 0]
        j = j[s[j] == small]
        if len(j):
            _deal(sa, j, t[j], place, -1 if small else 1)

    put(np.array([n]), False, head)  # the empty suffix stands before all
    for c in range(k):
        at = starts[c]
        while at < head[c]:
            at, new = head[c], sa[at : head[c]].copy()
            put(new, False, head)
        put(sa[ends[c] : starts[c + 1]], False, head)
    tail = starts[1:].copy()
    for c in range(k - 1, -1, -1):
        at = starts[c + 1]
        while at > tail[c]:
            at, new = tail[c], sa[tail[c] : at][::-1].copy()
            put(new, True, tail)
        put(sa[starts[c] : head[c]][::-1], True, tail)
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    rank, h, m = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(m, np.int64)
        second[: m - h] = rank[h:] + 1
        key = rank * (m + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(m, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == m - 1 or h >= m:
            return order


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` have in common, up to ``most``; eight bytes at a time.

    ``t`` has symbols of one or two bytes.
    """
    size = t.dtype.itemsize
    padded = np.zeros(len(t) + 8, t.dtype)
    padded[: len(t)] = t
    pieces, step, top = np.ndarray((len(t) + 1,), "<u8", padded, strides=(size,)), 8 // size, np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(most > 0)
    x, y, room = a[open_], b[open_], most[open_]
    done = 0
    while len(open_):
        differ = pieces[x] ^ pieces[y]
        more = (differ == 0) & (room > done + step)
        end = np.flatnonzero(~more)
        low = differ[end] & (~differ[end] + np.uint64(1))  # the lowest bit that differs tells the first symbol that does
        same = np.where(differ[end] == 0, step, np.searchsorted(_BITS[size], low, "right"))
        top[open_[end]] = np.minimum(done + same, room[end])
        done += step
        go = np.flatnonzero(more)
        open_, x, y, room = open_[go], x[go] + step, y[go] + step, room[go]
    return top


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``t`` (integers below 2^16) in lexicographic order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))])
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        flags = np.zeros(n, bool)
        flags[lms] = True
        sa = _induce(t, s, lms, starts)
        by_substring = sa[flags[sa]]
        t = np.ascontiguousarray(t, np.uint16)
        # an LMS substring ends with the next LMS suffix's first symbol; the last one, which the end closes, is unlike all
        end = np.zeros(n, np.int64)
        end[lms[:-1]] = lms[1:] + 1
        size = end[by_substring] - by_substring
        a, b = by_substring[1:], by_substring[:-1]
        alike = (size[1:] == size[:-1]) & (size[1:] > 0)
        alike[alike] = _shared(t, a[alike], b[alike], size[1:][alike]) == size[1:][alike]
        names = np.concatenate([[0], np.cumsum(~alike)])
        if names[-1] < len(lms) - 1:
            name_at = np.empty(n, np.int64)
            name_at[by_substring] = names
            lms = lms[_reduced(name_at[lms])]
        else:
            lms = by_substring
    return _induce(t, s, lms, starts)


def _reduced(names: np.ndarray) -> np.ndarray:
    """The suffix array of a reduced string: by recursion while its alphabet allows steps by symbol, else by doubling."""
    return suffix_array(names.astype(np.uint16)) if int(names.max()) < SYMBOLS and len(names) > 8 * SYMBOLS else _by_doubling(names)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in text order, the prefix it shares with the one before it in the array, up to ``most``.

    Symbols are compared themselves, so the result is exact.
    """
    n = len(t)
    plcp = np.zeros(n, np.int64)
    if n > 1:
        plcp[sa[1:]] = _shared(t, sa[1:], sa[:-1], np.minimum(most, n - np.maximum(sa[1:], sa[:-1])))
    return plcp
