"""Texts whose polynomial hashes meet, very long texts, and groups that would be quadratic."""

import random
import time
import zlib

import numpy as np
import pytest
from corpus import frame, texts
from test_join_and_search import brute
from test_substrings import by_bytes, by_words

from palimpsest.llm import ngram_join, recompression, repeats, suffix_dedup, textkit, token_store
from palimpsest.llm.wavelet import CHUNK, WaveletMatrix


def thue_morse(n: int, x: str, y: str) -> str:
    return "".join((x, y)[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (512, 1024, 2048)]


def test_hashes_tell_complementary_sequences_apart():
    for a, b in PAIRS:
        data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        _, _, h, _, check = textkit.words(data, np.array([0, len(data)]), check=True)
        assert h[0] != h[1] and check[0] != check[1]
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 1 << 60, 2).astype(np.uint64)
    a = np.array([(x, y)[bin(i).count("1") % 2] for i in range(1024)])
    assert textkit.windows(a, 1024)[0] != textkit.windows(np.where(a == x, y, x), 1024)[0]


def test_hashes_are_those_of_the_content_alone():
    ws = ["a", "ab", "abcdefgh", "abcdefghi", "é" * 30, "x" * 5000]
    seen = {}
    for lead in ("", "z ", "zz zzz "):
        data = np.frombuffer((lead + " ".join(ws)).encode(), np.uint8)
        starts, ends, h, _ = textkit.words(data, np.array([0, len(data)]))
        for a, b, x in zip(starts, ends, h, strict=True):
            assert seen.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_all_operators_on_complementary_words(spark):
    ts = [t for p in PAIRS for t in p]
    filler = " ".join(f"w{i}" for i in range(12))
    ts += [f"{filler} {t}" for t in PAIRS[-1]] + [" ".join(PAIRS[-1]), " ".join(PAIRS[-1][::-1])]
    rows = list(enumerate(ts))
    docs = frame(spark, ts)
    assert {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in suffix_dedup.dedup(docs).collect()} == by_bytes(rows)
    assert {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in recompression.dedup(docs).collect()} == by_words(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()} == brute(rows, 4, 85)
    tok = _tokenizer()
    for r in token_store.store(docs).collect():
        ids = [*tok.encode(ts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    true = ngram_join._names
    poor = lambda s: (len(s), true(s)[1])  # noqa: E731  # any two sets of one size clash
    monkeypatch.setattr(ngram_join, "_names", poor)
    monkeypatch.setattr(ngram_join, "_node", lambda s, clashes=frozenset(): poor(s)[poor(s)[0] in clashes])
    ts = texts(11, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(frame(spark, ts), 4, 85).collect()}
    assert got == brute(list(enumerate(ts)), 4, 85)


def test_encoder_falls_back_where_hashes_disagree(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path(token_store.VOCABULARY), "rb") as f:
        mine = token_store.Encoder(f.read())
    true = token_store.words

    def poor(*args, **more):
        starts, ends, h, row, check = true(*args, **more)
        return starts, ends, h & np.uint64(3), row, check

    data = np.frombuffer("one two three four five six seven".encode(), np.uint8)
    want = mine.encode(data, np.array([0, 14, len(data)]))
    monkeypatch.setattr(token_store, "words", poor)
    got = mine.encode(data, np.array([0, 14, len(data)]))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


@pytest.mark.parametrize("size", [300, 5000])
def test_long_texts_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(repeats, "SLICE_BYTES", size // 4)
    for module in (suffix_dedup, recompression):
        true = module._pieces
        monkeypatch.setattr(module, "_pieces", lambda data, true=true: true(data, size))
    rng = random.Random(5)
    line = lambda k: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(k))
    passage, long = line(80), line(9000)
    ts = [passage, long + "\n" + passage + " " + long[:20_000], "", None, line(50) + " " + passage, long[500:30_000], "x" * 30_000, passage.replace(" ", "\n\n  ")]
    rows = list(enumerate(ts))
    docs = frame(spark, ts)
    assert {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in suffix_dedup.dedup(docs).collect()} == by_bytes(rows)
    assert {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in recompression.dedup(docs).collect()} == by_words(rows)


def test_texts_of_several_megabytes(spark):
    rng = random.Random(6)
    base = " ".join(rng.choice(["river", "stone", "x1", "été"]) + str(rng.randint(0, 10**6)) for _ in range(400_000))
    assert len(base) > 4_000_000
    ts = [base, base[:3_000_000] + " tail", "short text " * 3]
    docs = frame(spark, ts)
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    want = len(base[:3_000_000].encode())
    assert (got[0].n_removed, got[0].n_bytes) == (0, len(base.encode())) and want <= got[1].n_removed <= want + 5
    got = {r.doc_id: r for r in recompression.dedup(docs).collect()}
    n = len(ts[1].split())
    assert got[0].n_removed == 0 and n - 3 <= got[1].n_removed <= n
    assert {r.component_id for r in ngram_join.link(docs).collect()} == {0, 1, 2}
    assert {r.doc_id: r.n_tokens for r in token_store.store(docs).collect()}[0] == len(_tokenizer().encode(base, add_special_tokens=False).ids) + 1


def test_short_texts_under_one_line_are_not_paired(spark):
    line = "the same first line stands over each of these short texts"
    docs = spark.range(20_000).selectExpr("id as doc_id", f"concat('{line} ', id, case when id % 1000 = 0 then ' more' else '' end) as text")
    began = time.time()
    got = ngram_join.link(docs).selectExpr("sum(int(doc_id = component_id))", "count(*)").first()
    assert tuple(got) == (20_000, 20_000)
    assert time.time() - began < 120


def test_matrix_over_many_chunks():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 60_000, CHUNK + 17), np.full(2 * CHUNK, 7), rng.integers(0, 9, 99)]).astype(np.uint32)
    loaded = []
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    load = w.load
    w.load = lambda level, c: loaded.append((level, c)) or load(level, c)
    at = np.array([0, 5, CHUNK, 3 * CHUNK, len(ids) - 1])
    assert w.access(at[:1]).tolist() == ids[:1].tolist() and len(loaded) <= 2 * 16
    assert w.access(at).tolist() == ids[at].tolist() and w.decode().tolist() == ids.tolist()
    for s in (7, 3, 59_999, int(ids[0])):
        assert w.occurrences(s).tolist() == np.flatnonzero(ids == s).tolist()
        assert w.rank(s, len(ids)) == w.count(s) and w.rank(s, CHUNK) == int((ids[:CHUNK] == s).sum())
    wide = WaveletMatrix.from_bytes(WaveletMatrix.build(ids + np.uint32(1 << 20), 21).to_bytes())
    assert wide.decode().tolist() == (ids + (1 << 20)).tolist()


def test_questions_to_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 64)
    ts = texts(9, 40)
    docs, path, tok = frame(spark, ts), str(tmp_path / "shards"), _tokenizer()
    token_store.store(docs, path=path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(ts)}
    asked = [2, ids[3][0], ids[7][1], 65_000, -1]
    assert {r.token: r.n for r in token_store.count(spark, path, asked).collect()} == {t: sum(x.count(t) for x in ids.values()) for t in asked}
    got = sorted(tuple(r) for r in token_store.occurrences(spark, path, asked).collect())
    assert got == sorted((t, d, k) for t in set(asked) for d, x in ids.items() for k, y in enumerate(x) if y == t)
    wanted = [(d, k) for d, x in ids.items() for k in range(len(x))] + [(3, 10_000), (3, -1), (999, 0)]
    got = {(r.doc_id, r.at): r.token for r in token_store.access(spark, path, spark.createDataFrame(wanted, "doc_id long, at long")).collect()}
    assert got == {(d, k): ids[d][k] if d in ids and 0 <= k < len(ids[d]) else None for d, k in wanted}
    # starts are those of one sum over all shards
    shards = [r for r in spark.read.parquet(path).select("shard", "n_tokens").orderBy("shard").collect()]
    assert {r.shard: r["_start"] for r in token_store.starts(spark.read.parquet(path)).collect()} == {r.shard: sum(x.n_tokens for x in shards[:i]) for i, r in enumerate(shards)}


def test_a_token_of_a_shard_of_many_documents(spark, tmp_path):
    """The work follows the shard's documents, not their square."""
    path = str(tmp_path / "shards")
    docs = spark.range(100_000).selectExpr("id as doc_id", "'w' as text").coalesce(1)
    token_store.store(docs, path=path)
    wanted = spark.createDataFrame([(99_999, 1), (5, 0), (5, 9)], "doc_id long, at long")
    began = time.time()
    got = {(r.doc_id, r.at): r.token for r in token_store.access(spark, path, wanted).collect()}
    assert got[99_999, 1] == 2 and got[5, 0] == _tokenizer().encode("w", add_special_tokens=False).ids[0] and got[5, 9] is None
    assert time.time() - began < 60
