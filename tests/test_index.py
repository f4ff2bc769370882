"""Stored postings: batches in any order, deletions, merges, two writers; top-k over them against plain scoring."""

import datetime as dt
import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import blockmax, index
from palimpsest.operators.index import Index
from palimpsest.session import Engine
from palimpsest.sources.commits import Commits


def words(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}x" for _ in range(rng.randint(0, 60))) or None) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "msg_id long, text string")


def state(x: Index):
    rows = lambda df: sorted(map(tuple, df.collect()))
    return rows(x.postings()), rows(x.lengths()), x.snapshot().totals()


def plain(rows, asked, kind, k=10):
    """(query, msg_id, score) by scoring every message."""
    docs = {i: set((t or "").split()) for i, t in rows}
    docs = {i: s for i, s in docs.items() if s}
    n = len(docs)
    mean = sum(map(len, docs.values())) / n
    df = Counter(t for s in docs.values() for t in s)
    queries = defaultdict(set)
    for q, t in asked:
        queries[q].add(t)
    out = []
    for q, ts in queries.items():
        scored = []
        for i, s in docs.items():
            hit = ts & s
            if not hit:
                continue
            if kind == "bm25":
                score = round(sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(s) / mean)) for t in hit), 6)
            elif kind == "count":
                score = len(hit)
            elif kind == "all":
                if hit != ts:
                    continue
                score = 0
            else:
                w = lambda t: math.log((n + 1) / (df[t] + 1)) + 1
                score = round(sum(w(t) ** 2 for t in hit) / math.sqrt(sum(w(t) ** 2 for t in s)) / math.sqrt(sum(w(t) ** 2 for t in ts if df[t])), 3)
                if score <= 0.05:
                    continue
            scored.append((-score, i))
        scored = sorted(scored) if kind == "all" else sorted(scored)[:k]
        out += [(q, i, -s) for s, i in scored]
    return sorted(out)


def test_batches_in_any_order_equal_one_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    rows = words(120)
    df = frame(spark, rows)
    whole, parts = Index(spark, str(tmp_path / "a")), Index(spark, str(tmp_path / "b"))
    assert whole.update(df) == 120
    order = list(range(6))
    random.Random(3).shuffle(order)
    for b in order:  # late ids: batch by the remainder, in a shuffled order
        assert parts.update(df.where(f"msg_id % 6 = {b}")) == 20
    assert parts.update(df.where("msg_id % 6 < 3")) == 0  # repeated
    assert state(parts) == state(whole)
    assert len(parts.segments()) <= (index.FANOUT - 1) * 3  # follows the logarithm of the batches
    assert max(s["level"] for s in parts.segments()) == 1
    parts.rebuild()
    assert len(parts.segments()) == 1 and state(parts) == state(whole)
    parts.clean()
    assert state(parts) == state(whole)


def test_rows_without_id_or_text_and_repeated_ids(spark, tmp_path):
    x = Index(spark, str(tmp_path))
    assert x.update(frame(spark, [])) == 0 and state(x) == ([], [], (0, 0))
    assert x.update(frame(spark, [(None, "a bb"), (1, None), (2, ""), (3, "bb cc"), (3, "bb dd")])) == 3
    assert state(x) == ([("bb", 3, 2), ("cc", 3, 2)], [(3, 2)], (1, 2))
    assert x.update(frame(spark, [(1, "now it has"), (3, "other")])) == 0


def test_a_batch_that_fails_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    x = Index(spark, str(tmp_path))
    x.update(frame(spark, words(10)))
    before = state(x)
    monkeypatch.setattr(x.commits, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        x.update(frame(spark, [(100, "new words")]))
    assert state(Index(spark, str(tmp_path))) == before
    monkeypatch.undo()
    assert x.update(frame(spark, [(100, "new words")])) == 1


def test_a_writer_that_was_overtaken_looks_again(spark, tmp_path, monkeypatch):
    a, b = Index(spark, str(tmp_path)), Index(spark, str(tmp_path))
    real, done = a.commits.commit, []

    def overtaken(number, entry):
        if not done:
            done.append(1)
            b.update(frame(spark, [(1, "shared words"), (2, "more words")]))
        return real(number, entry)

    monkeypatch.setattr(a.commits, "commit", overtaken)
    assert a.update(frame(spark, [(1, "shared words"), (3, "third")])) == 1
    assert state(a)[1] == [(1, 2), (2, 2), (3, 1)]


def test_deleted_messages_are_hidden_until_they_come_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 8)
    rows = words(60)
    x, left = Index(spark, str(tmp_path / "a")), Index(spark, str(tmp_path / "b"))
    x.delete(frame(spark, rows))  # nothing there yet
    for b in range(3):
        x.update(frame(spark, rows[20 * b : 20 * b + 20]))
    x.delete(frame(spark, rows).where("msg_id % 3 = 0"))
    left.update(frame(spark, [r for r in rows if r[0] % 3]))
    assert state(x) == state(left)
    asked = spark.createDataFrame([(1, "w1x"), (1, "w2x"), (2, "w7x")], "query_id int, token string")
    same = lambda f: sorted(map(tuple, f(x, asked).collect())) == sorted(map(tuple, f(left, asked).collect()))
    assert same(blockmax.bm25) and same(blockmax.tfidf_cosine) and same(blockmax.match_all)
    assert x.update(frame(spark, [(0, "again here")])) == 1  # commits a fourth segment, so the level is merged
    assert len(x.segments()) == 1 and not x.commits.latest()[1]["deleted"]
    left.update(frame(spark, [(0, "again here")]))
    assert state(x) == state(left)


SEARCHES = {"bm25": blockmax.bm25, "count": blockmax.count_match, "all": blockmax.match_all, "cosine": blockmax.tfidf_cosine}


@pytest.mark.parametrize("kind,block,named,tile", [*[(k, 16, 2000, 64) for k in SEARCHES], ("bm25", 3, 0, 2)])
def test_top_k_equals_plain_scoring(spark, tmp_path, monkeypatch, kind, block, named, tile):
    search = SEARCHES[kind]
    monkeypatch.setattr(index, "BLOCK_DOCS", block)
    monkeypatch.setattr(index, "NAMED", named)
    monkeypatch.setattr(blockmax, "TILE", tile)
    monkeypatch.setattr(blockmax, "PASS_ROWS", 20)
    monkeypatch.setattr(blockmax, "FEW", 0 if kind != "count" else 256)
    rows = words(300, seed=5)
    x = Index(spark, str(tmp_path))
    for b in range(2):
        x.update(frame(spark, rows).where(f"msg_id % 2 = {b}"))
    rng = random.Random(7)
    asked = sorted({(q, f"w{int(rng.paretovariate(0.7)) % 300}x") for q in range(12) for _ in range(rng.randint(1, 6))} | {(99, "nowhere"), (5, "nowhere")})
    found = search(x, spark.createDataFrame(asked, "query_id int, token string"))
    score = {"bm25": "score", "count": "hits", "cosine": "score"}.get(kind)
    got = sorted((r["query_id"], r["msg_id"], r[score] if score else 0) for r in found.collect())
    want = plain(rows, asked, kind)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert search(Index(spark, str(tmp_path / "none")), spark.createDataFrame(asked, "query_id int, token string")).count() == 0
    assert search(x, spark.createDataFrame([], "query_id int, token string")).count() == 0


def test_a_search_reads_the_row_groups_of_its_tokens(spark, tmp_path, monkeypatch):
    rows = [(k, f"aa{k:04d} mm{k:04d} zz{k:04d}") for k in range(4000)]
    monkeypatch.setattr(index, "ROW_GROUP", 4096)
    x = Index(spark, str(tmp_path))
    x.update(frame(spark, rows))
    df = x.snapshot().blocks(["aa0007"])
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    read = [plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()]
    assert read[0] < 12_000 / 2  # less than half of the token rows


def test_blocks_are_skipped_by_their_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 4)
    monkeypatch.setattr(blockmax, "FIRST", 6)
    monkeypatch.setattr(blockmax, "FEW", 0)
    rows = [(k, "common " + " ".join(f"f{k}y{j}" for j in range(k % 40))) for k in range(400)] + [(1000 + k, "common rare") for k in range(12)]
    x = Index(spark, str(tmp_path))
    x.update(frame(spark, rows))
    seen = []
    real = blockmax._score
    monkeypatch.setattr(blockmax, "_score", lambda r, *a: seen.append(r.select("block").distinct().count()) or real(r, *a))
    got = blockmax.bm25(x, spark.createDataFrame([(1, "common"), (1, "rare")], "query_id int, token string")).collect()
    assert {r.msg_id for r in got} <= set(range(1000, 1012))
    assert max(seen) < 20 < x.snapshot().blocks().select("block").distinct().count()


def test_commits_are_exclusive_and_kept_short(spark, tmp_path):
    a, b = (Commits(spark, str(tmp_path / "c")) for _ in range(2))
    assert a.latest() == (0, {})
    assert a.commit(1, {"x": 1}) and not b.commit(1, {"x": 2})
    assert b.latest() == (1, {"x": 1})
    for n in range(60):
        (a if n % 2 else b).change(lambda s: {"x": s["x"] + 1})
    assert a.latest() == (61, {"x": 61}) and len(a._numbers()) <= 50
    assert a.change(lambda s: None) == {"x": 61}


def test_two_writers_lose_and_double_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Engine, "FANOUT", 3)
    one, two = (Engine(spark, str(tmp_path), clock=lambda: dt.datetime(2024, 5, 1)) for _ in range(2))
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit((one if k % 2 else two).record, [("user", f"message {k} number one"), ("user", f"message {k} number two")]) for k in range(5)]
        assert [j.result() for j in jobs] == [2] * 5
    rows = one.table("messages").collect()
    assert len({r.msg_id for r in rows}) == len(rows) == 10
    assert {r.text for r in rows} == {f"message {k} number {n}" for k in range(5) for n in ("one", "two")}
    assert one.table("memories").count() == 10
    assert len(one.commits.latest()[1]["tables"]["messages"]) < 4  # merged


def test_a_batch_with_a_key_counts_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    assert e.record([("user", "hello there, friend")], key="k1") == 1
    assert e.record([("user", "hello there, friend")], key="k1") == 0
    assert e.table("messages").count() == 1
    e.record([("user", "我决定用 Rust"), ("user", "真开心")])
    e.soul_export(str(tmp_path / "soul"))
    n = e.table("decisions").count()
    assert n and e.soul_merge(str(tmp_path / "soul"), once=True) and not e.soul_merge(str(tmp_path / "soul"), once=True)
    assert e.table("decisions").count() == 2 * n


def test_late_messages_of_a_conversation_are_found(spark, tmp_path):
    """Ids hold the conversation in their high bits, so a later turn of an earlier conversation has a smaller id."""
    x = Index(spark, str(tmp_path))
    key = lambda conv, turn: (conv << 20) + turn
    x.update(frame(spark, [(key(1, 0), "alpha"), (key(2, 0), "beta")]))
    x.update(frame(spark, [(key(1, 1), "gamma")]))
    assert [r.msg_id for r in x.postings().where(F.col("token") == "gamma").collect()] == [key(1, 1)]
    assert json.dumps(x.segments())


# ---------------------------------------------------------------- folded tables


def test_folded_tables_equal_a_full_fold(spark, tmp_path):
    from palimpsest.operators import folded
    from palimpsest.operators.state import latest

    rng = random.Random(2)
    rows = [(rng.randint(0, 20), i, rng.choice([None, "a", "b"])) for i in range(120)]
    schema = "k long, seq long, v string"
    last = folded.Folded(spark, str(tmp_path / "a"), schema, folded.latest_rows("k", ["seq"]))
    total = folded.Folded(spark, str(tmp_path / "b"), "k long, n long, low string, high long", folded.sums("k", n="sum", low="min", high="max"))
    for b in range(6):
        part = spark.createDataFrame(rows[20 * b : 20 * b + 20], schema)
        assert last.add(part, b) and not last.add(part, b)
        assert total.add(part.select("k", F.lit(1).cast("long").alias("n"), F.col("v").alias("low"), F.col("seq").alias("high")), b)
    every = spark.createDataFrame(rows, schema)
    assert sorted(map(str, last.read().collect())) == sorted(map(str, latest(every, "k", ["seq"]).collect()))
    want = every.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("seq").alias("high"))
    assert sorted(map(str, total.read().collect())) == sorted(map(str, want.collect()))
    assert [f["level"] for f in last.folders()] in ([1, 0, 0], [0, 0, 1])  # reads touch the folded part and the open ones
    last.compact(everything=True)
    assert len(last.folders()) == 1 and last.read().count() == every.select("k").distinct().count()
    assert folded.Folded(spark, str(tmp_path / "c"), schema, folded.latest_rows("k", ["seq"])).read().count() == 0


def test_vectors_replace_what_a_message_had(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.vectors_put(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "msg_id long, embedding array<float>"))
    e.vectors_put(spark.createDataFrame([(2, [0.5, 0.5])], "msg_id long, embedding array<float>"))
    assert {r.msg_id: r.embedding for r in e.vectors().collect()} == {1: [1.0, 0.0], 2: [0.5, 0.5]}
