"""Small awkward corpora: nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""

import random

from pyspark.sql import types as T

WORDS = ["the", "of", "River", "stone,", "été", "größe", "naïve", "中文", "x1", "alpha", "beta", "gamma", "delta", "run", "run", "jump!", "sky.", "a", "b", "c"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use inside
    + [T.StructField(n, T.StringType()) for n in ("node", "token", "doc", "entries", "_s", "_n", "_copy", "score", "size", "at")]
)


def texts(seed: int, n: int = 40) -> list:
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(k))
    passage, base = line(40), line(120)
    out = [None, "", " \n\t ", "one", "two words", "run " * 60, line(3000)]
    for _ in range(n):
        kind = rng.randint(0, 5)
        if kind == 0:
            out.append(base)
        elif kind == 1:
            ws = base.split(" ")
            for _ in range(rng.randint(1, 4)):
                ws[rng.randrange(len(ws))] = "edit" + str(rng.randint(0, 9999))
            out.append(" ".join(ws))
        elif kind == 2:
            out.append(line(rng.randint(0, 30)) + "\n" + passage + "  " + line(rng.randint(0, 30)))
        elif kind == 3:
            out.append(line(6) + "\n" + line(6) + "\n" + passage[: rng.randint(80, 200)])
        else:
            out.append(line(rng.randint(1, 150)))
    return out


def frame(spark, ts, ids=None):
    ids = range(len(ts)) if ids is None else ids
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "s1", "s2", "s10"][k % 4], None if k % 5 == 0 or t is None else len(t), *["x"] * 10) for k, (i, t) in enumerate(zip(ids, ts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
