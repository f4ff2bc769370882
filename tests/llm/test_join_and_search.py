import re

import pytest
from corpus import empty, frame, texts

from palimpsest.llm import decontaminate, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t, k):
    ws = WORD.findall((t or "").translate(LOWER))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(rows, k, percent):
    sets, parent = {i: grams(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_components_equal_brute_force(spark, seed, k, percent):
    ts = texts(seed, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(frame(spark, ts), k, percent).collect()}
    assert got == brute(list(enumerate(ts)), k, percent)


def test_keep_one_keeps_columns_and_the_least_id(spark):
    ts = texts(4, 50)
    docs = frame(spark, ts)
    got = ngram_join.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, (_, c) in brute(list(enumerate(ts)), 5, 80).items() if i == c)


def test_join_handles_missing_and_repeated_ids(spark):
    ts = ["a b c d e f", "a b c d e f", None, "", "q r s t u v"]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(frame(spark, ts, [3, None, None, 7, 7])).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, 3), (None, 3, 3), (None, 0, None), (7, 0, 7), (7, 3, 7)], key=str)
    assert ngram_join.link(empty(spark)).count() == 0


def test_containment_equals_brute_force(spark):
    ts = texts(5, 40)
    items = [(1, " ".join(ts[-1].split()[:30])), (2, ts[12]), (3, "one"), (4, None), (5, ""), (6, "not in there at all ever"), (1, " ".join(ts[-1].split()[:30]))]
    want = []
    for i, t in {(i, t) for i, t in items}:
        ws = WORD.findall((t or "").translate(LOWER))
        k = min(5, len(ws))
        if k:
            s = grams(t, k)
            for d, x in enumerate(ts):
                xs = WORD.findall((x or "").translate(LOWER))
                both = len(s & {tuple(xs[p : p + k]) for p in range(len(xs) - k + 1)})
                if both >= 0.8 * len(s):
                    want.append((d, i, len(s), both))
    it = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, ts)
    got = [(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.find(docs, it).collect()]
    assert sorted(got) == sorted(want)
    kept = decontaminate.clean(docs, it)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(ts))) - {w[0] for w in want})


def test_items_in_several_blocks_and_empty_tables(spark, monkeypatch):
    docs = frame(spark, ["a b c d e f g", "h i j k l m"])
    it = spark.createDataFrame([(1, "a b c d e f"), (2, "h i j k l m")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 3)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, it).collect()) == [(0, 1), (1, 2)]
    assert decontaminate.clean(docs, it).count() == 0
    assert decontaminate.find(empty(spark), it).count() == 0
    assert decontaminate.find(docs, it.limit(0)).count() == 0
    assert decontaminate.clean(docs, it.limit(0)).count() == 2


def test_sql_of_decontamination(spark, duck):
    from compare import same
    SF = "/root/testdata/sf0.001"

    same(decontaminate.query(spark, SF).toPandas(), duck.sql(decontaminate.SQL).df())


def test_components_of_random_graphs(spark):
    import random

    from palimpsest.llm.components import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [tuple(rng.sample(range(100, 160), 2)) for _ in range(45)] + [(200, 200), (201, 202), (202, 201)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent if n != 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
