"""Keys of few intervals are joined without bins."""

import random

from palimpsest.operators import spans


def test_keys_of_few_intervals_need_no_bins(spark, monkeypatch):
    rng = random.Random(3)
    held = [(k, s := rng.randint(-50, 300), rng.choice([None, s, s + rng.randint(1, 90)]), 1000 * k + i) for k, n in ((1, 80), (2, 9), (3, 1)) for i in range(n)]
    asked = [(rng.choice([1, 2, 3, 4]), rng.randint(-80, 900), i) for i in range(400)]
    want = sorted((j, i) for k, t, j in asked for q, s, e, i in held if k == q and s <= t and (e is None or t < e))
    h, m = spark.createDataFrame(held, "k int, start long, until long, h int"), spark.createDataFrame(asked, "k int, at long, m int")
    for few in (100, 10, 0):  # no key, one key, all keys by bins
        monkeypatch.setattr(spans, "FEW", few)
        found = spans.as_of_many(m, h, "k", "at", "start", "until")
        assert sorted((r.m, r.h) for r in found.collect()) == want
        assert ("Generate" in found._jdf.queryExecution().optimizedPlan().toString()) == (few < 100)
