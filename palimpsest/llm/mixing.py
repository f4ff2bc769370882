"""Mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated per source, targets follow by water-filling, and each document is taken
floor(rate) times plus one more time with probability equal to the rate's fraction. The coin is a
seeded hash of the document, so reruns and retried tasks agree.

Independent coins would miss a source's target by the size of its largest documents. So the coins are
drawn by strata: documents of a source and of about one size (a class) are taken with the least coins,
as many as the fraction asks for, rounded by a seeded offset. Classes are settled from the largest size
down, and what one class misses in words is added to what the next ones owe, as far as they have room
to make up for it either way. Rounding is unbiased, so each document's probability is the fraction.
The classes' table has a few hundred rows a source; documents are neither sorted nor shuffled.

Defined cases: a null or empty text has size 0 and is taken by the same rule; a null source is a
source of its own and comes last; repeated rows are mixed one by one (equal rows share a coin); a
document without id gets its coin from its text; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, join_groups
from .textkit import checkpoint

SEED = 20_240_613
#: A source is taken this many times at most.
MOST = 3
#: Coins are counted in so many bins a class.
COIN_BINS = 1024
#: Rows of the classes' table (sources times classes) up to which it is broadcast: some tens of bytes each.
CLASSES = 200_000


def source_targets(totals: DataFrame, total_share: float = 1.0, most: int = MOST) -> DataFrame:
    """``target`` for each row of (source, source_size): shares by weight 1, 2, 3, repeating in code point order.

    Targets stop at ``most`` times the size; what is cut is shared again by weight. In order of
    size over weight the sources that stop come first, so one pass with running sums finds the
    level at which the rest stand. The table has one row per source, never one per document.
    """
    everything = W.partitionBy(F.lit(1))
    ranked = totals.withColumn("_rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("_rank") - 1) % 3 + 1).cast("double")).withColumn("_cap", (most * F.col("source_size")).cast("double"))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_all", F.sum("source_size").over(everything).cast("double") * total_share)
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_free", F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level")))
        .withColumn("_level", F.first("_free", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _coin(seed: int) -> Column:
    """A number in [0, COIN_BINS): its whole part is the coin's bin, the rest decides within the bin."""
    coin = F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    return F.shiftrightunsigned(coin, 11).cast("double") / float((1 << 53) // COIN_BINS)


def _class(size: Column) -> Column:
    """Sizes below 32 each, larger ones by their five leading bits."""
    bits = F.length(F.bin(size))
    return F.when(size < 32, size).otherwise(bits * 32 + F.floor(size / F.pow(F.lit(2.0), bits - 5))).cast("int")


def _rate(most: int) -> Column:
    return F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)


def _due(classes: DataFrame, seed: int) -> DataFrame:
    """(source, _class, _k): how many documents of each class get one more copy, from (source, _class, _n, _words, _f)."""
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "source", "_class"), 11).cast("double") / float(1 << 53)
    cells = F.struct("_class", F.col("_n").cast("double").alias("n"), F.col("_words").cast("double").alias("w"), offset.alias("u"), F.col("_f").alias("f"))

    def step(a: Column, x: Column) -> Column:
        f, n, w = x["f"], x["n"], x["w"]
        some = w > 0
        # as much of what is owed as leaves the class room whatever the earlier offsets were: so no probability shifts
        room = lambda words, bound: F.when(bound > 0, words / bound).otherwise(1.0)
        part = F.when(some, F.least(F.lit(1.0), room((1 - f) * w, a["most"]), room(f * w, a["least"]))).otherwise(0.0)
        asked = f * n + F.when(some, part * a["owed"] * n / w).otherwise(0.0)
        k = F.greatest(F.lit(0.0), F.least(n, F.floor(asked + x["u"]).cast("double")))
        mean = F.when(n > 0, w / n).otherwise(0.0)
        over = asked - F.floor(asked)
        sure = (a["most"] == 0) & (a["least"] == 0)
        bound = lambda name, first: F.when(sure, first * mean).otherwise((1 - part) * a[name] + mean).alias(name)
        out = F.concat(a["out"], F.array(F.struct(x["_class"].alias("_class"), k.cast("long").alias("_k"))))
        return F.struct((a["owed"] + f * w - k * mean).alias("owed"), bound("most", over), bound("least", 1 - over), out.alias("out"))

    zero = F.lit(0.0)
    start = F.struct(zero.alias("owed"), zero.alias("most"), zero.alias("least"), F.expr("cast(array() as array<struct<_class:int,_k:bigint>>)").alias("out"))
    folded = classes.groupBy("source").agg(F.sort_array(F.collect_list(cells), False).alias("_c")).select("source", F.aggregate("_c", start, step)["out"].alias("_o"))
    return folded.select("source", F.inline("_o"))


def plan(sized: DataFrame, seed: int = SEED, most: int = MOST, total_share: float = 1.0) -> DataFrame:
    """(source, _class, source_size, target, _cut, _share) for documents' (source, size, _coin).

    One more copy goes to the coins in bins below ``_cut``, and to the share ``_share`` of that bin.
    """
    bins = checkpoint(sized.groupBy("source", _class(F.col("size")).alias("_class"), F.floor("_coin").cast("int").alias("_bin")).agg(F.count("*").alias("_docs"), F.sum("size").alias("_words")))
    totals = bins.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = checkpoint(source_targets(totals, total_share, most).drop("weight"))
    classes = bins.groupBy("source", "_class").agg(F.sum("_docs").alias("_n"), F.sum("_words").alias("_words"))
    due = _due(join_groups(classes, targets, ["source"]).withColumn("_f", _rate(most) - F.floor(_rate(most))), seed)
    # at most COIN_BINS rows a class
    before = F.coalesce(F.sum("_docs").over(W.partitionBy("source", "_class").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = join_groups(bins.withColumn("_before", before), checkpoint(due), ["source", "_class"], CLASSES).where("_before < _k")
    last = cuts.groupBy("source", "_class").agg(F.max_by(F.struct("_bin", ((F.col("_k") - F.col("_before")) / F.col("_docs")).alias("share")), "_bin").alias("_x"))
    known = join_groups(classes.select("source", "_class"), last, ["source", "_class"], CLASSES)
    return checkpoint(join_groups(known.select("source", "_class", F.coalesce("_x._bin", F.lit(-1)).alias("_cut"), F.coalesce("_x.share", F.lit(0.0)).alias("_share")), targets, ["source"]))


def _copies(most: int) -> Column:
    bin_ = F.floor("_coin")
    more = (bin_ < F.col("_cut")) | ((bin_ == F.col("_cut")) & (F.col("_coin") - bin_ < F.col("_share")))
    return (F.floor(_rate(most)) + more.cast("int")).cast("long")


def mix(docs: DataFrame, seed: int = SEED, most: int = MOST, total_share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for each row of ``docs`` (doc_id, text, source)."""
    sized = checkpoint(docs.select("doc_id", "source", size_of().alias("size"), _coin(seed).alias("_coin")))
    keyed = sized.withColumn("_class", _class(F.col("size")))
    out = join_groups(keyed, plan(sized, seed, most, total_share), ["source", "_class"], CLASSES)
    return out.select("doc_id", "source", "size", "source_size", "target", _rate(most).alias("rate"), _copies(most).alias("copies"))


def emit(docs: DataFrame, seed: int = SEED, most: int = MOST, total_share: float = 1.0) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with all their columns, each as often as the mix takes it.

    A document's copies follow from its own coin and its class's row, so texts are never shuffled
    while the classes' table is small.
    """
    slim = plan(docs.select("source", size_of().alias("size"), _coin(seed).alias("_coin")), seed, most, total_share).withColumnRenamed("source", "_s")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["source"].alias("_s"), _class(size_of()).alias("_class"), _coin(seed).alias("_coin"))
    taken = join_groups(keyed, slim, ["_s", "_class"], CLASSES).withColumn("_n", _copies(most)).where("_n > 0")
    return taken.withColumn("_copy", F.explode(F.expr("sequence(1L, _n)"))).select("_row.*")


def query(spark, sf_dir):
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate")
