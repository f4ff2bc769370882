"""A wide search scores its blocks once, several ways share that, and a build shuffles no text of a first batch."""

import pytest
from test_index import frame, plain, words

from palimpsest.operators import blockmax, index
from palimpsest.operators.index import Index, Snapshot

ASKED = sorted({(q, f"w{(7 * q + j * j) % 40}x") for q in range(12) for j in range(5)} | {(3, "nowhere")})


@pytest.fixture
def held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 16)
    monkeypatch.setattr(index, "NAMED", 5)
    monkeypatch.setattr(index, "FREQUENT", 20)
    monkeypatch.setattr(blockmax, "FEW", 0)
    monkeypatch.setattr(blockmax, "SHARED", 3)
    x = Index(spark, str(tmp_path))
    x.update(frame(spark, words(200, seed=9)))
    return x


def test_ways_share_one_round(spark, held, monkeypatch):
    rounds, real = [], blockmax._score
    monkeypatch.setattr(blockmax, "_score", lambda *a: rounds.append(1) or real(*a))
    at = held.snapshot()
    ways = [blockmax.by_count(every=True), blockmax.by_bm25(at), blockmax.by_count(), blockmax.by_cosine(at)]
    got = blockmax.search(at, spark.createDataFrame(ASKED, "query_id int, token string"), ways, 10).collect()
    assert len(rounds) == 1
    for n, kind in enumerate(["all", "bm25", "count", "cosine"]):
        want = [w for w in plain(words(200, seed=9), ASKED, kind)]
        if kind == "all":  # the ten of smallest ids
            want = [w for w in want if sum(v[0] == w[0] and v[1] < w[1] for v in want) < 10]
        mine = sorted((r.query_id, r.msg_id, r.score) for r in got if r.way == n)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert kind == "all" or all(abs(m[2] - w[2]) < 2e-6 for m, w in zip(mine, want, strict=True))


def test_norms_of_frequent_and_rare_tokens_and_after_deletion(spark, held):
    held.update(frame(spark, [(1000, "rare1 rare2 w1x"), (1001, None)]))
    held.delete(frame(spark, [(k, "") for k in range(0, 200, 4)]))
    rows = [r for r in words(200, seed=9) if r[0] % 4] + [(1000, "rare1 rare2 w1x")]
    asked = [*ASKED, (50, "rare1")]
    got = blockmax.tfidf_cosine(held, spark.createDataFrame(asked, "query_id int, token string")).collect()
    assert sorted((r.query_id, r.msg_id, r.score) for r in got) == [(q, i, pytest.approx(s, abs=2e-6)) for q, i, s in plain(rows, asked, "cosine")]


def test_a_first_batch_meets_nothing(spark, tmp_path, monkeypatch):
    met = []
    real = Snapshot.met
    monkeypatch.setattr(Snapshot, "met", lambda self, given: met.append(1) or real(self, given))
    x = Index(spark, str(tmp_path))
    assert x.update(frame(spark, words(20))) == 20 and not met
    assert x.update(frame(spark, words(25))) == 5 and met
