import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import SF, same
from corpus import empty, frame, texts
from pyspark.sql import functions as F

from palimpsest.llm import ball_kmeans, byte_cnn, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    """docs and items: (id, text); the contract's formula, document by document."""
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := split(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        ts = split(text)
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in ts}
        scored = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(index, items, k=10):
    return sorted(tuple(r) for r in lexical_search.search(index, items, k).select("item_id", "rank", "doc_id", "score").collect())


def built(spark, docs, tmp_path):
    path = f"{tmp_path}/index"
    lexical_search.build(docs, path)
    return lexical_search.load(spark, path)


def test_search_matches_sql(spark, duck):
    same(lexical_search.query(spark, SF).toPandas(), duck.sql(lexical_search.SQL).df())


@pytest.mark.parametrize("seed,block", [(1, 3), (2, 64), (3, 1)])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, seed, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "PASS_ITEMS", 7)
    monkeypatch.setattr(lexical_search, "SENT_BYTES", 0 if seed == 1 else 1 << 20)
    ts = texts(seed, 60)
    ids = list(range(len(ts)))
    ids[20], ids[30] = None, 7  # a row without an id, and a repeated id
    docs = frame(spark, ts, ids)
    rng = random.Random(seed)
    asked = [(i, " ".join(rng.choice(lexical_words(ts)) for _ in range(rng.randint(1, 12)))) for i in range(20)]
    asked += [(0, asked[0][1]), (1, "another text of item one stone run"), (97, None), (98, ""), (99, "!!"), (100, "nowherefound"), (101, "run RUN run Run")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert found(built(spark, docs.repartition(3), tmp_path), items) == plain_search(list(zip(ids, ts, strict=True)), asked)


def lexical_words(ts):
    return sorted({w for t in ts for w in split(t)})


def test_search_of_equal_scores_and_awkward_tables(spark, tmp_path):
    ts = ["alpha beta"] * 40 + ["beta"] * 3 + ["alpha " * 50]
    docs = frame(spark, ts, list(range(100, 144)))
    items = spark.createDataFrame([(1, "alpha"), (2, "alpha beta beta")], "item_id long, text string")
    assert found(built(spark, docs, tmp_path / "a"), items) == plain_search(list(zip(range(100, 144), ts, strict=True)), [(1, "alpha"), (2, "alpha beta beta")])
    for d, i in ((empty(spark), items), (docs, items.limit(0)), (frame(spark, [None, "", "..."]), items)):
        assert found(built(spark, d, tmp_path / str(random.random())), i) == []


def test_search_of_very_long_texts(spark, tmp_path):
    rng = random.Random(5)
    ts = [" ".join(f"w{rng.randint(0, 40_000)}" for _ in range(400_000)), "w1 w2 w3", "w1 " * 900_000]
    docs = frame(spark, ts)
    asked = [(1, "w1 w2"), (2, "w3 w39999 w17")]
    assert found(built(spark, docs, tmp_path), spark.createDataFrame(asked, "item_id long, text string")) == plain_search(list(enumerate(ts)), asked)


def test_blocks_below_the_threshold_are_not_scored(spark, tmp_path):
    """Documents that hold all of an item's terms fill the first blocks; the others' bounds fall short."""
    ts = [f"rare{i % 7} common" for i in range(2000)] + ["alpha beta gamma common"] * 30
    index = built(spark, frame(spark, ts).coalesce(1), tmp_path)
    asked = lexical_search.Asked([(1, [b"alpha", b"beta", b"common"])])
    docs, total = 2030, 2 * 2000 + 4 * 30
    probe = lexical_search._probe(index, spark.sparkContext.broadcast(asked), docs, total)
    asked.weigh(docs, lexical_search._frequencies(probe, 3))
    got = plain_search(list(enumerate(ts)), [(1, "alpha beta common")])
    least = np.array([got[-1][3]])
    assert probe.count() == index.count() > 25
    assert lexical_search._reaching(probe, spark.sparkContext.broadcast(asked), least).count() <= 2


# ---------------------------------------------------------------- clusters


def plain_kmeans(rows, k=40, rounds=5, width=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    x = np.array([v for _, v in kept], np.int64)

    def assign():
        d = ((x[:, None, :] - np.array(centroids, np.int64)[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = assign()
        centroids = [[int(s) // int((own == j).sum()) for s in x[own == j].sum(0)] if (own == j).any() else c for j, c in enumerate(centroids)]
    own, d = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), int(o), int(e), int(d[own == o].sum()), int(d.sum()), sha[o]) for (i, _), o, e in zip(kept, own, d, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string"


def clustered(df, **kw):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in ball_kmeans.cluster(df, **kw).collect())


def test_clusters_match_sql(spark, duck):
    same(ball_kmeans.query(spark, SF).toPandas(), duck.sql(ball_kmeans.SQL).df())


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, 64))
    x = (centres[rng.integers(0, 12, 400)] + rng.normal(0, 0.05 if seed else 0.5, (400, 64))).astype(np.float32)
    x[50:120] = x[50]  # many copies of one vector
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(400, None), (401, [1.0] * 63), (402, [float("nan")] * 64), (403, [None] + [0.0] * 63), (404, [float("inf")] * 64), (7, [0.25] * 64), (None, [0.5] * 64), (None, [-0.5] * 64)]
    df = spark.createDataFrame([(*r, 0, "a", "b") for r in rows], VECTORS).repartition(3)
    assert clustered(df) == plain_kmeans(rows)


def test_clusters_of_small_and_empty_tables(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]  # equal centroids: the smaller number wins
    df = spark.createDataFrame([(*r, 0, "a", "b") for r in rows], VECTORS)
    assert clustered(df) == plain_kmeans(rows)
    assert ball_kmeans.cluster(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustered(df.limit(0)) == clustered(spark.createDataFrame([(1, None, 0, "", "")], VECTORS)) == []
    with pytest.raises(Exception, match="out of range"):
        clustered(spark.createDataFrame([(1, [3e30] * 64, 0, "", "")], VECTORS))


def test_reassign_compares_less_and_equals_nearest():
    rng = np.random.default_rng(3)
    c = rng.integers(-200, 200, (30, 16))
    x = c[rng.integers(0, 30, 3000)] + rng.integers(-25, 26, (3000, 16))
    own, _ = ball_kmeans.nearest(x, c + rng.integers(-3, 4, c.shape))
    apart = np.stack([ball_kmeans.squares(c, y) for y in c])
    got, d, compared = ball_kmeans.reassign(x, own, c, apart)
    best, e = ball_kmeans.nearest(x, c)
    assert (got == best).all() and (d == e).all()
    assert compared < 0.2 * len(x) * len(c)


# ---------------------------------------------------------------- language


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_windows_cover_every_byte_of_every_text():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 5, byte_cnn.WINDOW, 0, byte_cnn.WINDOW + 1, 5000, 0)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.cumsum([0, *map(len, parts)])
    seen = [b""] * len(parts)
    for row, size, x in byte_cnn.windows(data, offsets, most=4):
        for r, n, w in zip(row, size, x, strict=True):
            seen[r] += w[:n].tobytes()
            rest = parts[r][len(seen[r]) : len(seen[r]) + 3]
            assert w[n : n + 3].tobytes() == rest.ljust(3, b"\0")
    assert seen == parts


def test_pair_tables_give_the_filters_responses():
    net = byte_cnn.Network(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (5, byte_cnn.WINDOW + 3)).astype(np.uint8)
    plain = net.responses(x)
    w = net.tables[1]
    by_hand = sum(float(w[k][x[2, 9 + k], 4]) for k in range(3))
    assert abs(plain[1][2, 9, 4] - by_hand) < 1e-5
    for a, b in zip(plain, net.ready().responses(x), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_folded_letters():
    assert byte_cnn.folded(np.frombuffer("ÀÉÞ×ÿ Ab1".encode(), np.uint8)).tobytes() == "àéþ×ÿ ab1".encode()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = byte_cnn.query(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert len(tested) > 250
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_held_out_labels_and_sources_are_never_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = sorted(map(tuple, byte_cnn.predict(docs, byte_cnn.train(docs)).collect()))
    b = sorted(map(tuple, byte_cnn.predict(docs, byte_cnn.train(other)).collect()))
    assert a == b


def test_language_of_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_cnn.train(docs)
    long = "der und nicht die mit keit " * 120_000
    odd = frame(spark, [None, "", " 12 ... 34\n", "中文", long, "x"], [1, 2, 3, 4, None, 5])
    got = {(r.doc_id): (r.lang_pred, r.score) for r in byte_cnn.predict(odd, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in net.languages and got[5][0] in net.languages
    assert got[None][0] == "de"
    assert byte_cnn.predict(empty(spark), net).count() == 0
    nothing = byte_cnn.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r)[1:] for r in byte_cnn.predict(odd, nothing).collect()} == {("und", 0.0)}
    one = byte_cnn.train(docs.withColumn("lang", F.lit("qq")))
    assert {r.lang_pred for r in byte_cnn.predict(odd, one).collect()} == {"und", "qq"}
    assert byte_cnn.examples(empty(spark))[2] == []
