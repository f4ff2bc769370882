"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A rule looks at a share of a text that ordinary texts have too: punctuation and symbols, the mean
size of a word, words said before. Its limit is a fence around the group's own middle half: a quartile
plus or minus a multiple of the distance between the quartiles, which has a small floor.

The sketch is a log-linear histogram: a value below 256 has its own bin, larger ones share a bin with
those of the same eight leading bits, so a quantile is off by 1/128 at most. Bins are plain counts:
sketches merge by addition, in any order, with partial aggregation, and reruns agree to the bit.
Quartiles of a group are weighed against its language's, and those against the whole table's, as if
the latter stood for ``PRIOR`` more documents, so limits of small groups pass over smoothly.

DataFrame functions only. Counting repeated word windows sorts hashes (64 bits, within one document)
inside an array expression; nothing is exploded and no text is shuffled.

Defined cases: a null or empty text has no words, so it fails the base rule; null language or source
is a group of its own; repeated rows each get their verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_groups, table
from .textkit import checkpoint

MIN_WORDS = 50
#: Percent of words in repeated 3-word windows beyond which the base rule fails.
MOST_REPEATED = 50
#: Documents that the next larger group's quartiles stand for.
PRIOR = 20
#: Metric -> (least distance between the quartiles in millionths, multiples of it below and above that are still kept; None: no limit).
RULES = {
    "marks": (2_000, None, 4.0),
    "word_size": (100_000, 4.0, 4.0),
    "again": (20_000, None, 2.0),
}
#: ASCII punctuation and symbols.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SCALE = 1_000_000

_REPEATED = """
transform(array(words), ws -> CASE WHEN size(ws) < 3 THEN 0 ELSE
  transform(array(transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))), hs ->
    CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0 ELSE
      transform(array(sort_array(transform(hs, (h, i) -> struct(h AS h, i AS i)))), s ->
        size(array_distinct(flatten(transform(
          filter(s, (x, k) -> get(s, k - 1).h = x.h OR get(s, k + 1).h = x.h),
          x -> array(x.i, x.i + 1, x.i + 2)))))
      )[0] END
  )[0] END
)[0]"""


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_marks, n_dup_lines, n_repeat_words, n_distinct)."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    out = docs.select("doc_id", "lang", "source", t.alias("_t"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("_lines"), count("#*$%&|<>").alias("n_symbols"), count(MARKS).alias("n_marks"))
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_marks",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def metrics() -> dict[str, Column]:
    """What the rules look at, in millionths; 0 for texts without words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.floor(F.lit(_SCALE) * a / F.col(b))).otherwise(0).cast("long")
    return {"marks": share(F.col("n_marks"), "word_chars"), "word_size": share(F.col("word_chars"), "n_words"), "again": share(F.col("n_words") - F.col("n_distinct"), "n_words")}


def bin_of(v: Column) -> Column:
    """Log-linear bin: the value itself below 256, else its bit length and eight leading bits."""
    bits = F.length(F.bin(v))
    return F.when(v < 256, v).otherwise(bits * 256 + F.floor(v / F.pow(F.lit(2.0), bits - 8))).cast("int")


def bin_top(b: Column) -> Column:
    """The largest value of a bin."""
    bits = F.floor(b / 256)
    return F.when(b < 256, b.cast("double")).otherwise((b - bits * 256 + 1) * F.pow(F.lit(2.0), bits - 8) - 1)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bin, n): one sketch per group and metric. ``rows`` has the metrics' columns."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in RULES]))
    return rows.select(*keys, long.alias("x")).groupBy(*keys, "x.metric", "x.bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, low, high): the quartiles of each sketch, read off its bins in order."""
    bins = F.sort_array(F.collect_list(F.struct("bin", "n")))  # as many as a sketch has bins: a few thousand at most
    hit = lambda a, x, seen, name, q: F.when(a[name].isNull() & (seen >= F.col("total") * q), x["bin"]).otherwise(a[name]).alias(name)

    def step(a: Column, x: Column) -> Column:
        seen = a["seen"] + x["n"]
        return F.struct(seen.alias("seen"), hit(a, x, seen, "low", 0.25), hit(a, x, seen, "high", 0.75))

    none = F.lit(None).cast("int")
    folded = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), none.alias("low"), none.alias("high")), step)
    grouped = sketch.groupBy(*keys, "metric").agg(bins.alias("bins"), F.sum("n").alias("total")).withColumn("_f", folded)
    return grouped.select(*keys, "metric", F.col("total").cast("double").alias("total"), bin_top(F.col("_f.low")).alias("low"), bin_top(F.col("_f.high")).alias("high"))


def _limits() -> dict[str, Column]:
    """Limit name -> its value, for a group's row per metric (metric, low, high)."""
    out = {}
    for m, (floor, below, above) in RULES.items():
        spread = F.greatest(F.col("high") - F.col("low"), F.lit(float(floor)))
        for name, k, limit in ((f"min_{m}", below, F.col("low") - F.lit(below or 0.0) * spread), (f"max_{m}", above, F.col("high") + F.lit(above or 0.0) * spread)):
            if k is not None:
                out[name] = F.max(F.when(F.col("metric") == m, limit)).alias(name)
    return out


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, the rules' limits) from the group's sketch, weighed against its language's and the whole table's."""
    fine = checkpoint(sketches(rows, ["lang", "source"]))
    by_lang = fine.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    by_all = fine.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    weighed = lambda of, n, prior: (F.col(n) * F.col(of) + F.lit(float(PRIOR)) * F.col(prior)) / (F.col(n) + F.lit(float(PRIOR)))
    every = quartiles(by_all, []).select(F.col("metric").alias("_am"), F.col("low").alias("_alow"), F.col("high").alias("_ahigh"))
    lang = quartiles(by_lang, ["lang"]).select(F.col("lang").alias("_l"), F.col("metric").alias("_m"), F.col("total").alias("_n"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    lang = lang.join(every, F.col("_m") == F.col("_am")).select("_l", "_m", weighed("_low", "_n", "_alow").alias("_low"), weighed("_high", "_n", "_ahigh").alias("_high"))
    g = quartiles(fine, ["lang", "source"])
    got = g.join(lang, g["lang"].eqNullSafe(lang["_l"]) & (g["metric"] == lang["_m"]))
    per = got.select("lang", "source", "metric", weighed("low", "total", "_low").alias("low"), weighed("high", "total", "_high").alias("high"))
    return per.groupBy("lang", "source").agg(*_limits().values())


def judge(docs: DataFrame) -> DataFrame:
    """Every row's counts, metrics, limits and verdict (``base_failed``, ``kept``)."""
    rows = checkpoint(features(docs).withColumns(metrics()))
    judged = join_groups(rows, checkpoint(thresholds(rows)), ["lang", "source"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = F.lit(True)
    for name in _limits():
        m = name[4:]
        fine = fine & (F.col(m) >= F.col(name) if name.startswith("min_") else F.col(m) <= F.col(name))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES, *_limits())
