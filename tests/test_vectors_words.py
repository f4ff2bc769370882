"""Vector search and vocabularies against plain loops; digests of replicas; interval bins."""

import random
import time

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from palimpsest.functions import lexicon
from palimpsest.operators import replica, spans, vectors, vocabulary

VECTORS = "vec_id long, embedding array<float>"


def plain_top(rows, asked, k=10):
    out = []
    for q, y in asked:
        scored = []
        for i, x in rows:
            ok = x is not None and len(x) == len(y) and None not in x and any(x)
            a, b = (np.array(x, float), np.array(y, float)) if ok else (None, None)
            scored.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 6) if ok else 0.0, i))
        out += [(q, i, r + 1, -s + 0.0) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_exact_scan_equals_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PASS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in np.float32(rng.normal(0, 1, 16))]) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(15)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [None] * 16), (404, [1.0] * 8)]
    asked = [(q, rows[7 * q][1]) for q in range(7)] + [(90, [1.0] * 8)]
    df, q = spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame([*asked, (99, None)], "query_id long, query array<double>")
    got = sorted((r.query_id, r.vec_id, r["rank"], r.score) for r in vectors.exact_top(df, q).collect())
    want = plain_top(rows, asked)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert vectors.exact_top(df.limit(0), q).count() == vectors.exact_top(df, q.limit(0)).count() == 0


def test_lists_find_nine_of_ten(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 32))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.4, (4000, 32))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], VECTORS)
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vectors.Lists.build(df, str(tmp_path))
    found, exact = index.search(q), vectors.exact_top(df, q)
    r = vectors.recall(found, exact).first()
    assert r.queries == 200 and r.wanted == 2000 and r.recall >= 0.9
    assert index.probes < vectors.LISTS / 2  # these vectors lie in groups
    assert vectors.recall(index.search(q, probes=vectors.LISTS), exact).first().recall >= 0.999
    none = vectors.Lists.build(df.limit(0), str(tmp_path / "none"))
    assert none.search(q).count() == 0 and index.search(q.limit(0)).count() == 0


def test_recall_on_the_tables_vectors(spark):
    from palimpsest.plans import more

    r = more.QUERIES["vector_index_recall"](spark, "/root/testdata/sf0.01").first()
    assert r.queries == 25 and r.recall >= 0.9


# ---------------------------------------------------------------- vocabularies


def plain_mood(text, words, version=None):
    """words: (word, mood, version)."""
    low, found = (text or "").lower(), {}
    best = None
    for w, mood, since in words:
        w = w.lower()
        at = low.find(w)
        if at < 0 or w == "" or mood not in lexicon.MOOD_ORDER or version is not None and since > version:
            continue
        if mood == lexicon.HAPPY and any(n in low[max(0, at - 8) : at] for n in lexicon.NEGATORS):
            continue
        found.setdefault(w, set()).add(mood)
        key = (lexicon.MOOD_ORDER.index(mood), -len(w), w)
        best = min(best or key, key)
    return (lexicon.MOOD_ORDER[best[0]] if best else "", best[2] if best else "", len(found))


def test_moods_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    base = [w for ws in lexicon.MOODS.values() for w in ws] + lexicon.NEGATORS
    new = [("gloom", lexicon.MOOD_ORDER[2], 5), ("Gloomy", lexicon.MOOD_ORDER[3], 2), ("loom", lexicon.MOOD_ORDER[6], 9), ("x", "nomood", 0), ("", lexicon.MOOD_ORDER[0], 0)]
    texts = ["".join(rng.choice([*base, " ", "gloomy", "loom", "ab ", "Loom!"]) for _ in range(rng.randint(0, 7))) for _ in range(300)] + [None, ""]
    rows = [(i, t, rng.choice([None, 0, 3, 6, 12])) for i, t in enumerate(texts)]
    vocab = vocabulary.learn(vocabulary.builtin(spark), spark.createDataFrame(new, vocabulary.WORDS))
    messages = spark.createDataFrame(rows, "msg_id long, text string, version long")
    words = [(w, m, 0) for m in lexicon.MOOD_ORDER for w in lexicon.MOODS[m]] + new
    for size in (1 << 20, 40):  # one automaton, and many
        monkeypatch.setattr(vocabulary, "SENT_BYTES", size)
        got = {r.msg_id: (r.mood, r.mood_word, r.mood_words) for r in vocabulary.moods(messages, vocab).collect()}
        assert got == {i: plain_mood(t, words, v) for i, t, v in rows}


def test_built_in_moods_are_those_of_the_column_function(spark):
    from palimpsest.functions import text
    from palimpsest.plans import said

    rows = said.said(spark, SF).select("msg_id", "text", text.mood(F.col("text")).alias("plain"))
    got = vocabulary.moods(rows, vocabulary.builtin(spark))
    assert got.where("mood <> plain").count() == 0 and got.where("mood <> ''").count() > 5


def test_a_learnt_word_counts_once_and_from_its_version_on(spark):
    sad = lexicon.MOOD_ORDER[2]
    new = spark.createDataFrame([("gloom", sad, 5), ("gloom", sad, 7), ("gloom", "unknown", 1)], vocabulary.WORDS)
    vocab = vocabulary.learn(vocabulary.builtin(spark), new)
    assert vocabulary.learn(vocab, new).count() == vocab.count() == vocabulary.builtin(spark).count() + 1
    m = spark.createDataFrame([(1, "GLOOM", 4), (2, "gloom", 5), (3, "gloom", None)], "msg_id long, text string, version long")
    assert {r.msg_id: r.mood for r in vocabulary.moods(m, vocab).collect()} == {1: "", 2: sad, 3: sad}


def test_tallies_take_the_longest_word_from_the_left(spark):
    a, b = lexicon.MOOD_ORDER[1], lexicon.MOOD_ORDER[2]
    vocab = spark.createDataFrame([("rain", a, 0), ("rainy day", b, 0), ("day", a, 3)], vocabulary.WORDS)
    m = spark.createDataFrame([(1, "Rainy day, rain and day", 3), (2, "day", 1), (3, None, 1)], "msg_id long, text string, version long")
    assert sorted(map(tuple, vocabulary.tallies(m, vocab).collect())) == sorted([(1, a, 2), (1, b, 1)])


def test_a_hundred_thousand_words_cost_one_pass(spark):
    """The time for a text doesn't follow the number of words."""
    sad = lexicon.MOOD_ORDER[2]
    text = "nothing of that kind is in here " * 3000
    took = {}
    for n in (100, 100_000):
        a = vocabulary._automaton([(f"word{i:06d}", 2, 0) for i in range(n)])
        began = time.process_time()
        assert list(vocabulary._hits(a, text, None, 6, [])) == []
        took[n] = time.process_time() - began
    assert took[100_000] < 20 * took[100] + 0.5
    many = spark.range(100_000).select(F.format_string("word%06d", "id").alias("word"), F.lit(sad).alias("mood"), F.lit(0).cast("long").alias("version"))
    m = spark.createDataFrame([(1, "has word099999 in it"), (2, "none")], "msg_id long, text string")
    assert {r.msg_id: r.mood_word for r in vocabulary.moods(m, many).collect()} == {1: "word099999", 2: ""}


@pytest.mark.parametrize("name", ["learnt_moods"])
def test_learnt_moods_match_sql(spark, duck, name):
    from compare import same

    from palimpsest.plans import more

    got = more.QUERIES[name](spark, SF).toPandas()
    same(got, duck.sql(more.SQL[name]).df())
    assert (got["mood"] != "").sum() > 10


# ---------------------------------------------------------------- replicas

ROWS = "id long, month string, a string, b string"


def test_differences_name_exactly_the_planted_rows(spark):
    rows = [(i, f"2024-{i % 5:02d}" if i % 7 else None, None if i % 3 else "x", f"t{i}") for i in range(500)] + [(None, None, None, "n")] * 2 + [(600, "2024-01", "twice", "r")] * 2
    copy = [r for r in rows if r[0] not in (3, 77)] + [(900, "2024-09", "new", None), (901, None, None, None)]
    swap = {10: (10, "2024-00", "t10", None), 11: (11, rows[11][1], "x", "t11"), 12: (12, "2030-01", *rows[12][2:])}  # a null changes its place; a value for a null; another month
    copy = [swap.get(r[0], r) for r in copy]
    copy.remove((600, "2024-01", "twice", "r"))
    copy.remove((None, None, None, "n"))
    a, b = spark.createDataFrame(rows, ROWS), spark.createDataFrame(copy, ROWS).repartition(3)
    got = {r.id: r.status for r in replica.differences(a, b, "id", F.col("month")).collect()}
    assert got == {3: "missing", 77: "missing", 900: "added", 901: "added", 10: "changed", 11: "changed", 12: "changed", 600: "missing", None: "missing"}
    assert replica.differences(a, a, "id", F.col("month")).count() == 0
    assert replica.differences(a, a.limit(0), "id", F.col("month")).where("status = 'missing'").count() == 502
    assert replica.differences(replica.repaired(a, b, "id", F.col("month")), a, "id", F.col("month")).count() == 0


def test_digests_of_batches_add_up(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("month"), F.concat(F.lit("v"), "id").alias("a"))
    d = lambda x: replica.digest(x, "id", F.col("month"))
    rows = lambda x: sorted(map(tuple, x.select("month", "bucket", "n", "s1", "s2").collect()))
    assert rows(replica.merged(d(df.where("id < 100")), d(df.where("id >= 100")))) == rows(d(df))
    other = df.withColumn("a", F.when(F.col("id") == 150, "changed").otherwise(F.col("a")))
    assert [r.month for r in replica.leaves_apart(d(df), d(other)).collect()] == ["0"]


def test_shrinking_tables_are_told():
    assert replica.shrunk({"a": 80, "b": 95, "c": 1}, {"a": 100, "b": 100}) == {"a": 20}


# ---------------------------------------------------------------- intervals


def test_moments_meet_their_intervals(spark):
    rng = random.Random(6)
    held = [(rng.choice([1, 2, None]), rng.randint(-50, 300), rng.choice([None, *range(-50, 320)]), i) for i in range(150)] + [(1, None, 5, 900), (1, 7, 7, 901)]
    asked = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(-80, 400)]), i) for i in range(300)]
    h = spark.createDataFrame(held, "k int, start long, until long, h int")
    m = spark.createDataFrame(asked, "k int, at long, m int")
    found = spans.as_of_many(m, h, "k", "at", "start", "until")
    assert sorted((r.m, r.h) for r in found.collect()) == sorted((j, i) for k, t, j in asked for q, s, e, i in held if k == q and k is not None and t is not None and s is not None and s <= t and (e is None or t < e))
    # bounds in days, moments in microseconds
    day = 86_400_000_000
    d = spans.as_of_many(m.withColumn("at", F.col("at") * day + 12345), h.withColumns({"start": F.col("start") * day, "until": F.col("until") * day}), "k", "at", "start", "until")
    assert sorted((r.m, r.h) for r in d.collect()) == sorted((r.m, r.h) for r in found.collect())
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert spans.as_of_many(m.limit(0), h, "k", "at", "start", "until").count() == spans.as_of_many(m, h.limit(0), "k", "at", "start", "until").count() == 0


def test_an_interval_has_few_bins(spark):
    df = spark.createDataFrame([(1, 1_000_000)], "s long, e long")
    assert df.select(F.size(spans._bins(F.col("s"), F.col("e"), 21))).first()[0] <= 40
