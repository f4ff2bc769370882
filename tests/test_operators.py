import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import analytics, graph, log, memory, retrieval, sketches


def test_triples_from_text(spark):
    docs = spark.createDataFrame([(1, "我决定用 Rust，放弃了 Java"), (2, "Go比Ruby"), (3, "nothing")], "msg_id long, text string")
    got = {tuple(r)[1:] for r in graph.extract(docs).collect()}
    assert ("subject", "使用", "Rust") in got
    assert ("subject", "放弃", "Java") in got
    assert ("Go", "对比", "Ruby") in got


def test_intervals_merge_repeats_and_reopen(spark):
    t = dt.datetime
    rows = [(1, "lives", x, t(2024, 1, d), d) for d, x in ((1, "a"), (2, "a"), (3, "b"), (5, "a"))]
    facts = spark.createDataFrame(rows, "subject int, relation string, object string, ts timestamp_ntz, id int")
    got = [(r.object, r.valid_from.day, r.valid_until.day if r.valid_until else None) for r in graph.intervals(facts).orderBy("id").collect()]
    assert got == [("a", 1, 3), ("b", 3, 5), ("a", 5, None)]
    assert [r.object for r in graph.as_of(graph.intervals(facts), "2024-01-03 00:00:00").collect()] == ["b"]


def test_first_fact_wins(spark):
    facts = spark.createDataFrame([(1, "r", "x", 1, 1), (1, "r", "y", 2, 2), (1, "r", "x", 3, 3)], "subject int, relation string, object string, ts int, id int")
    assert [r.verdict for r in graph.first_wins(facts).orderBy("id").collect()] == ["stored", "conflict", "confirm"]


def test_rrf_prefers_what_both_lists_hold(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "c", 3), (1, 1, "b", 1), (1, 1, "d", 2), (1, 1, "a", 3)]
    got = retrieval.rrf(spark.createDataFrame(rows, "query_id int, list_id int, msg_id string, rank int")).orderBy(F.desc("score")).first()
    assert got.msg_id == "b"


def test_trust_is_held_after_each_step(spark):
    rows = [(1, i, i < 12) for i in range(15)]
    got = retrieval.trust_fold(spark.createDataFrame(rows, "msg_id int, seq int, helpful boolean")).first()
    assert got.trust == pytest.approx(0.7) and (got.helpful, got.unhelpful) == (12, 3)


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 2.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(retrieval.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_decay_matches_the_formula(spark):
    df = spark.createDataFrame([("episodic", 0.0, 0, 1.0), ("semantic", 0.0, 0, 1.0), ("emotional", 0.8, 3, 1.0)], "type string, arousal double, access_count int, weight double")
    got = {r.type: r.new_weight for r in memory.decay(df, 720.0).collect()}
    assert got["episodic"] == pytest.approx(math.exp(-1.5), abs=1e-6)
    assert got["semantic"] == 1.0
    assert got["emotional"] == pytest.approx(math.exp(-0.05 * (1 - 0.56) * 30 / (1 + math.log(4))), abs=1e-6)
    assert {r.new_weight for r in memory.decay(df, -1.0).collect()} == {1.0}


def test_pack_shares_the_budget(spark):
    rows = [(1, "procedural", 1.0, "x" * 33), (2, "procedural", 0.5, "x" * 33), (3, "semantic", 1.0, "x" * 33), (4, "emotional", 1.0, "x" * 33)]
    df = spark.createDataFrame(rows, "memory_id int, type string, weight double, content string")
    assert sorted(r.memory_id for r in memory.pack(df, 30).collect()) == [1, 2, 3]
    assert memory.pack(df, 5).count() == 0


def brute_leaders(n, pairs):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[b].add(a)
    lead, out = set(), {}
    for i in range(n):
        mine = sorted(near[i] & lead)
        out[i] = mine[0] if mine else i
        if not mine:
            lead.add(i)
    return out


def test_leaders_equal_the_sequential_rule(spark):
    import random

    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    p, n = spark.createDataFrame(pairs, "a int, b int"), spark.range(40).select(F.col("id").cast("int").alias("node"))
    assert {r.node: r.leader for r in memory.leaders(p, n).collect()} == brute_leaders(40, pairs)


def test_mem_consolidate_query(spark):
    import numpy as np
    from compare import SF

    from palimpsest.plans import said, views

    got = {r.node: r.leader for r in said.QUERIES["mem_consolidate"](spark, SF).collect()}
    m = views.memories(spark, SF).where("type in ('episodic', 'emotional')").select("memory_id", "type", "embedding").toPandas().sort_values("memory_id")
    lead, want = [], {}
    for r in m.itertuples():
        x = np.array(r.embedding, float)
        near = [i for i, t, y in lead if t == r.type and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.8]
        want[r.memory_id] = near[0] if near else r.memory_id
        if not near:
            lead.append((r.memory_id, r.type, x))
    assert got == want


def test_simhash_nears(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the dog"), (2, "the quick brown fox jumps over a dog"), (3, ""), (4, None)], "msg_id long, text string")
    got = {r.msg_id: r.simhash for r in sketches.fingerprints(docs).collect()}
    assert got[3] is None and got[4] is None and len(got[1]) == 32
    df = spark.createDataFrame([(got[1], got[2])], "a string, b string")
    assert df.select(sketches.hamming(F.col("a"), F.col("b"))).first()[0] == bin(int(got[1], 16) ^ int(got[2], 16)).count("1")


def test_bloom_has_no_false_negatives(spark):
    items = spark.range(300).select(F.concat(F.lit("w"), "id").alias("token"))
    bits = sketches.bloom(items, "token")
    assert sketches.probe(items, "token", bits).where("not seen").count() == 0
    fresh = spark.range(300).select(F.concat(F.lit("z"), "id").alias("token"))
    assert sketches.probe(fresh, "token", bits).where("seen").count() <= 3


def test_log_fate(spark):
    t = dt.datetime
    rows = [(1, t(2024, 1, 1), "user", "hi"), (2, t(2024, 1, 1), "agent", "ok"), (3, t(2024, 1, 1), "agent", "see 12345"), (4, t(2024, 2, 28), "agent", "ok")]
    df = spark.createDataFrame(rows, "msg_id int, ts timestamp_ntz, sender string, text string")
    assert [r.fate for r in log.fate(df, "2024-03-01").orderBy("msg_id").collect()] == ["moved", "dropped", "moved", "kept"]


def test_stability_of_one_row_is_left_out(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (2, 3)], "user_id int, drift int")
    assert [r.user_id for r in analytics.stability(df, ["user_id"]).collect()] == [2]


def test_mem_reclassify_groups_whole_texts(spark, tmp_path):
    from palimpsest.plans import behaviour

    texts = ["2024-01-05 tea with Ann", "2024-02-06 tea with Ann", "1月3日 tea with Ann", "tea with Bob", "tea at noon", "tea, cold"]
    rows = [(1, i, "user", x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in behaviour.QUERIES["mem_reclassify"](spark, str(tmp_path)).collect()] == [("tea with Ann", 3, 1 << 20)]


def test_memories_hold_whole_texts(spark, tmp_path):
    from palimpsest.plans import behaviour, extras

    tail = ["never the of", "der und heit dans", "xyz"]
    docs = [(4 * i, "q " * 200 + x) for i, x in enumerate(tail)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 4, [1.0]) for i, _ in docs], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda m, name: {r[0]: r for r in m.QUERIES[name](spark, str(tmp_path)).collect()}
    got = run(behaviour, "mem_persona_weight")
    assert {i: r.match > 0 for i, r in got.items()} == {0: True, 4: True, 8: False}
    assert run(extras, "persona_triggers").keys() == {i for i, x in docs if any(w in x for w in extras._FIELDS)} != set()
    assert {i: r.tokens for i, r in run(behaviour, "mem_context_pack").items()} == {i: (len(x) + 7) // 4 for i, x in docs}


def test_learned_tags_of_all_users(spark, tmp_path):
    from palimpsest.plans import more

    t = dt.datetime
    rows = [(1, 3, t(2024, 1, 2), "view", 1.0, '{"k": 1}'), (2, 900, t(2024, 1, 25), "purchase", 1.0, '{"k": 2}'), (3, 900, t(2024, 1, 26), "view", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.tag for r in more.QUERIES["learned_tags"](spark, str(tmp_path)).collect()] == ["s2spend"]


def test_scene_guess_reads_the_last_fifteen(spark, tmp_path):
    from palimpsest.plans import more

    texts = ["Freiheit", "station", *["well"] * 13, "moment"]
    rows = [(1, i, "user", x) for i, x in enumerate([*texts[:15], "well"])] + [(2, 0, "user", texts[-1])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in more.QUERIES["scene_guess"](spark, str(tmp_path)).collect()} == {(1, "work"), (2, "work")}


def test_contradictions_of_scenes_trends_and_annotations(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(1, i, "neutral", 0, i // 5, "a" if i < 5 else "b") for i in range(10)]  # a scene moves
    rows += [(2, i, "spend", -60, i // 5, "a" if i < 5 else "b") for i in range(10)]  # it moves with a switch
    rows += [(3, i, "neutral", 50 * (i % 3 - 1), 0, "a") for i in range(3)]  # volatile, too short for a trend
    rows += [(4, i, "neutral", 30 * i, 0, "a") for i in range(10)]  # volatile with a trend
    df = spark.createDataFrame([(u, i, day(i), d, x, st, sc) for u, i, d, x, st, sc in rows], "user_id int, event_id long, ts timestamp_ntz, direction string, drift int, stage int, scene string")
    assert sorted(map(tuple, analytics.contradictions(df).collect())) == [(1, "scene_moved_without_switch"), (3, "volatile")]
    notes = spark.createDataFrame([(1, "x", "压力期", "soft", "hard"), (2, "成本敏感型", None, None, None)], "user_id int, persona_type string, emotional_state string, reminder_tone string, prev_tone string")
    got = set(map(tuple, analytics.contradictions(df, notes).collect()))
    assert got == {(1, "scene_moved_without_switch"), (3, "volatile"), (1, "pressed_without_drift"), (1, "tone_changed"), (2, "cost_minded_but_spending")}


def test_persona_alerts_cool_down(spark):
    hour = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    rows = [(1, hour(0), 1, "spend", ""), (1, hour(23), 2, "spend", ""), (1, hour(24), 3, "neutral", "付费"), (1, hour(30), 4, "spend", ""), (2, hour(1), 5, "frugal", "省钱")]
    choices = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_id long, direction string, tags string")
    personas = spark.createDataFrame([(1, "省钱"), (2, "nothing")], "user_id int, text string")
    got = {r.event_id: r.alerts for r in analytics.persona_alerts(choices, personas).collect()}
    assert got == {1: ["spending_against_persona"], 3: ["stale_persona_spend"], 5: ["stale_persona_frugal"]}


def test_message_ids_hold_many_turns(spark, tmp_path):
    from palimpsest.plans import views

    rows = [(1, 0, "user", "a"), (0, 1000, "user", "b"), (0, 1_048_575, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert len({r.msg_id for r in views.messages(spark, str(tmp_path)).collect()}) == 3
    spark.createDataFrame([(0, 1 << 20, "user", "d")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/x/conversations.parquet")
    with pytest.raises(Exception, match="out of range"):
        views.messages(spark, f"{tmp_path}/x").select("msg_id").collect()


def test_hooks_take_callables(spark):
    from palimpsest.operators import hooks

    df = spark.createDataFrame([(1, "我决定用 Rust"), (2, None), (3, "abc")], "msg_id long, text string")
    got = {r.msg_id: r.embedding for r in hooks.embed(df, lambda ts: [[len(t), 1.0] for t in ts], size=2).collect()}
    assert got == {1: [9.0, 1.0], 2: [0.0, 1.0], 3: [3.0, 1.0]}
    with pytest.raises(Exception, match="doesn't fit"):
        hooks.embed(df, lambda ts: [[1.0] for _ in ts], size=2).collect()
    found = hooks.enrich(df, lambda ts: [[("x", "said", t), ("x", "said", t)] if t == "abc" else [] for t in ts], "user")
    assert sorted(map(tuple, found.collect())) == [(1, "user", "使用", "Rust"), (3, "x", "said", "abc")]
