import hashlib
import random
import re

import numpy as np
import pytest
from corpus import empty, frame, texts

from palimpsest.llm import recompression, suffix_dedup
from palimpsest.llm.suffix_array import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        t = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(1, 50))]
        sa = suffix_array(np.array(t, np.uint16))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        plcp = common_prefixes(np.array(t, np.uint16), sa, 100)
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert plcp[a] == k


def by_bytes(rows, length=100):
    seen, out = set(), {}
    for key, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.setdefault(key, []).append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_words(rows, length=13):
    seen, out = set(), {}
    for key, t in rows:
        ws, new = WORD.findall(t or ""), set()
        gone = [False] * len(ws)
        for p in range(len(ws) - length + 1):
            w = tuple(ws[p : p + length])
            if w in seen:
                gone[p : p + length] = [True] * length
            new.add(w)
        seen |= new
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.setdefault(key, []).append((len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, seed):
    ts = texts(seed)
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in suffix_dedup.dedup(frame(spark, ts)).collect()}
    assert got == by_bytes(enumerate(ts))


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed):
    ts = texts(seed)
    got = {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in recompression.dedup(frame(spark, ts)).collect()}
    assert got == by_words(enumerate(ts))


def test_wide_anchors_and_shuffled_lists(spark, monkeypatch):
    from palimpsest.llm import repeats

    monkeypatch.setattr(repeats, "WIDE", 1)
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    ts = texts(8)
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in suffix_dedup.dedup(frame(spark, ts)).collect()}
    assert got == by_bytes(enumerate(ts))
    got = {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in recompression.dedup(frame(spark, ts)).collect()}
    assert got == by_words(enumerate(ts))


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    ts = [t for t in texts(3, 12)]
    ids = [None, None, *[k // 2 for k in range(len(ts) - 2)]]
    order = sorted(zip(ids, ts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    got = {}
    for r in suffix_dedup.dedup(frame(spark, ts, ids)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_bytes(order).items()}
    got = {}
    for r in recompression.dedup(frame(spark, ts, ids)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_words(order).items()}


@pytest.mark.parametrize("op", [suffix_dedup, recompression])
def test_empty_table(spark, op):
    assert op.dedup(empty(spark)).count() == 0


def test_rounds_name_equal_parts_alike():
    rng = np.random.default_rng(0)
    part = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(1, 1 << 60, k).astype(np.uint64), part]) for k in (5, 17))

    def symbols(h):
        names, starts, row = h, np.arange(len(h)), np.zeros(len(h), int)
        for r in range(recompression.ROUNDS):
            names, starts, row = recompression.compress(names, starts, row, r)
        return dict(zip(starts.tolist(), names.tolist(), strict=True))

    x, y = symbols(a), symbols(b)
    inner = range(recompression.REACH, 60 - recompression.WIDEST - recompression.REACH)
    assert {k: x.get(5 + k) for k in inner} == {k: y.get(17 + k) for k in inner}
