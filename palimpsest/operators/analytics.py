"""Behaviour over time: drift, moods, scenes, stages, persona."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text


def last(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows under each key."""
    w = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def drift(decisions: DataFrame, key: str = "user_id", n: int = 50) -> DataFrame:
    """Weighted drift of the last ``n`` decisions under each key.

    Neighbouring decisions of one direction (neutral apart) merge as 0.7 of what was plus 0.3 of
    what came, cut to an integer, and weigh as many as merged.
    """
    recent = last(decisions, key, ["ts", "event_id"], n)
    w = W.partitionBy(key).orderBy("ts", "event_id")
    new = F.when((F.col("direction") == F.lag("direction").over(w)) & (F.col("direction") != "neutral"), 0).otherwise(1)
    runs = recent.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    folded = F.aggregate(F.slice("_v", 2, n), F.get("_v", F.lit(0)).cast("double"), lambda a, x: (a * 0.7 + x * 0.3).cast("int").cast("double"))
    per = runs.groupBy(key, "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "drift"))), lambda x: x["drift"]).alias("_v")).select(key, folded.alias("_d"), F.size("_v").alias("_w"))
    total = per.groupBy(key).agg(F.bround(F.sum(F.col("_d") * F.col("_w")) / F.sum("_w")).cast("int").alias("drift"), F.count("*").alias("runs"))
    votes = recent.groupBy(key).agg(*[F.count_if(F.col("direction") == d).alias(f"_{d}") for d in ("frugal", "spend", "drift", "neutral")], F.count("*").alias("decisions"))
    best = F.greatest("_frugal", "_spend", "_drift", "_neutral")
    major = F.when(F.col("_frugal") == best, "frugal").when(F.col("_spend") == best, "spend").when(F.col("_drift") == best, "drift").otherwise("neutral")
    return total.join(votes.select(key, major.alias("majority"), "decisions"), key)


def ratio(decisions: DataFrame, key: str = "user_id", n: int = 50) -> DataFrame:
    """Percent of each direction among the last ``n`` decisions that have one."""
    r = last(decisions, key, ["ts", "event_id"], n).where("direction <> 'neutral'").groupBy(key)
    return r.agg(F.count("*").alias("n"), *[F.bround(100.0 * F.count_if(F.col("direction") == d) / F.count("*"), 0).cast("int").alias(f"{d}_pct") for d in ("frugal", "spend", "drift")])


def stability(decisions: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Sample deviation of drift under the keys, and its band."""
    g = decisions.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.stddev_samp("drift"), 4).alias("deviation")).where(F.col("n") >= least)
    d = F.col("deviation")
    return g.withColumn("band", F.when(d < 15, "steady").when(d < 30, "mild").when(d < 50, "swinging").otherwise("wild"))


def slope(decisions: DataFrame, key: str = "user_id", n: int = 50, least: int = 10) -> DataFrame:
    """Least-squares slope of drift over its index, steps to the nearer bound of 60, confidence."""
    r = last(decisions, key, ["ts", "event_id"], n).withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy("ts", "event_id")))
    g = r.groupBy(key).agg(F.count("*").alias("n"), F.round(F.regr_slope("drift", "_i"), 6).alias("slope"), F.max_by("drift", "_i").alias("current")).where(F.col("n") >= least)
    bound = F.when(F.col("slope") > 0, 60).otherwise(-60)
    eta = F.when(F.col("slope") != 0, ((bound - F.col("current")) / F.col("slope")).cast("int"))
    return g.withColumn("eta", eta).withColumn("confidence", F.least(F.lit(70), F.greatest(F.lit(10), (100 - 20 * F.abs("slope")).cast("int"))))


def switch_flag(decisions: DataFrame, key: str = "user_id", n: int = 20, least: int = 8, strong: int = 60) -> DataFrame:
    """Whether ``least`` of the last ``n`` decisions go strongly one way."""
    g = last(decisions, key, ["ts", "event_id"], n).where(F.abs("drift") >= strong).groupBy(key, "direction").agg(F.count("*").alias("strong"))
    return g.withColumn("switches", F.col("strong") >= least)


def entropy(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Shannon entropy (natural logarithm) of a column under the keys, to four places."""
    c = rows.groupBy(*keys, column).agg(F.count("*").alias("_c"))
    p = F.col("_c") / F.sum("_c").over(W.partitionBy(*keys))
    return c.withColumn("_p", p).groupBy(*keys).agg(F.sum("_c").alias("n"), (F.round(-F.sum(F.col("_p") * F.log("_p")), 4) + 0.0).alias("entropy"))


def wind(moods: DataFrame, key: str = "user_id", n: int = 80) -> DataFrame:
    """Mean valence of the last ``n`` moods, to two places."""
    return last(moods, key, ["ts", "event_id"], n).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("valence"), 4).alias("wind"))


def scene_matrix(decisions: DataFrame) -> DataFrame:
    w = W.partitionBy("stage")
    m = decisions.groupBy("stage", "scene").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))
    return m.withColumn("share", F.bround(100.0 * F.col("n") / F.sum("n").over(w), 0).cast("int"))


def scene_shift(decisions: DataFrame, least: int = 0) -> DataFrame:
    """Each scene's share in the first and the last stage, and what changed."""
    m = scene_matrix(decisions)
    ends = m.agg(F.min("stage").alias("_a"), F.max("stage").alias("_b"))
    tagged = m.crossJoin(F.broadcast(ends))
    a = tagged.where("stage = _a").select("scene", F.col("share").alias("from_pct"))
    b = tagged.where("stage = _b").select("scene", F.col("share").alias("to_pct"))
    out = a.join(b, "scene", "full").select("scene", F.coalesce("from_pct", F.lit(0)).alias("from_pct"), F.coalesce("to_pct", F.lit(0)).alias("to_pct"))
    return out.withColumn("shift", F.col("to_pct") - F.col("from_pct")).where(F.abs("shift") >= least)


def emerging(recent: DataFrame, history: DataFrame, rise: int = 3, least: int = 2, fade: int = 3) -> DataFrame:
    """Words (one row each use) that are new or three times as frequent, and those that went; the two sets don't overlap."""
    r = recent.groupBy("word").agg(F.count("*").alias("rc"))
    h = history.groupBy("word").agg(F.count("*").alias("hc"))
    j = r.join(h, "word", "full").select("word", F.coalesce("rc", F.lit(0)).alias("rc"), F.coalesce("hc", F.lit(0)).alias("hc"))
    kind = F.when((F.col("rc") >= least) & ((F.col("hc") == 0) | (F.col("rc") / F.nullif(F.col("hc"), F.lit(0)) >= rise)), "emerging").when((F.col("hc") >= fade) & (F.col("rc") == 0), "fading")
    return j.withColumn("kind", kind).where("kind is not null")


def stage_similarity(decisions: DataFrame) -> DataFrame:
    """Shared scenes of each pair of stages over the larger set; stages are few, scenes are compared as sets."""
    s = decisions.select("stage", "scene").distinct()
    n = s.groupBy("stage").agg(F.count("*").alias("_n"))
    both = s.alias("a").join(s.alias("b"), "scene").where("a.stage < b.stage").groupBy(F.col("a.stage").alias("stage_a"), F.col("b.stage").alias("stage_b")).agg(F.count("*").alias("common"))
    pairs = both.join(n.select(F.col("stage").alias("stage_a"), F.col("_n").alias("_na")), "stage_a").join(n.select(F.col("stage").alias("stage_b"), F.col("_n").alias("_nb")), "stage_b")
    sim = F.bround(F.col("common") / F.greatest("_na", "_nb"), 2)
    return pairs.select("stage_a", "stage_b", "common", sim.alias("similarity")).withColumn("band", F.when(F.col("similarity") >= 0.7, "same").when(F.col("similarity") >= 0.4, "related").otherwise("apart"))


def stage_links(decisions: DataFrame) -> DataFrame:
    """Each stage with the next one: total drift and where it goes."""
    s = decisions.groupBy("stage").agg(F.count("*").alias("n"), F.sum("drift").alias("drift"), F.sum(F.abs("drift")).alias("turmoil"))
    w = W.partitionBy(F.lit(1)).orderBy("stage")  # one row per stage
    return s.withColumn("next_stage", F.lead("stage").over(w)).withColumn("next_drift", F.lead("drift").over(w)).where("next_stage is not null").withColumn("trend", F.when(F.col("next_drift") > F.col("drift"), "up").when(F.col("next_drift") < F.col("drift"), "down").otherwise("flat"))


def scene_moves(decisions: DataFrame, least: int = 30) -> DataFrame:
    """(user_id, scene, from_pct, to_pct): scenes whose share moved by ``least`` points from a user's first stage to the last."""
    m = decisions.groupBy("user_id", "stage", "scene").agg(F.count("*").alias("n"))
    share = F.bround(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("user_id", "stage")), 0).cast("int")
    w = W.partitionBy("user_id")
    ends = m.withColumn("share", share).withColumn("_a", F.min("stage").over(w)).withColumn("_b", F.max("stage").over(w)).where("_a < _b")
    at = lambda c: F.coalesce(F.max(F.when(F.col("stage") == F.col(c), F.col("share"))), F.lit(0))
    return ends.groupBy("user_id", "scene").agg(at("_a").alias("from_pct"), at("_b").alias("to_pct")).where(F.abs(F.col("to_pct") - F.col("from_pct")) >= least)


def contradictions(decisions: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Rules that a key's figures break: its talk against its drift, moves of a scene's share without a switch,
    volatility that no trend foretells (a slope of 0.1 does), its annotation against its drift.

    ``annotations`` (user_id, persona_type, emotional_state, reminder_tone, prev_tone): the latest one of each key.
    """
    per = decisions.groupBy("user_id").agg(F.count_if(F.col("direction") == "frugal").alias("f"), F.count_if(F.col("direction") == "spend").alias("s"), F.avg("drift").alias("d"), F.stddev_samp("drift").alias("v"))
    talk = per.where((F.col("f") > F.col("s")) & (F.col("d") <= -30)).select("user_id", F.lit("frugal_words_spending_drift").alias("rule"))
    back = per.where((F.col("s") > F.col("f")) & (F.col("d") >= 30)).select("user_id", F.lit("spending_words_frugal_drift").alias("rule"))
    foretold = slope(decisions).where(F.abs("slope") >= 0.1).select("user_id")
    wild = per.where(F.col("v") >= 40).join(foretold, "user_id", "left_anti").select("user_id", F.lit("volatile").alias("rule"))
    switched = switch_flag(decisions).where("switches").select("user_id")
    moved = scene_moves(decisions).select("user_id").distinct().join(switched, "user_id", "left_anti").select("user_id", F.lit("scene_moved_without_switch").alias("rule"))
    out = talk.unionAll(back).unionAll(wild).unionAll(moved)
    if annotations is None:
        return out
    c = F.col
    rules = [
        F.when(c("persona_type").contains("成本") & (c("majority") == "spend") & (F.abs("drift") >= 30), "cost_minded_but_spending"),
        F.when(c("emotional_state").contains("压力") & (c("majority") != "drift"), "pressed_without_drift"),
        F.when((c("reminder_tone") != "") & (c("prev_tone") != "") & (c("reminder_tone") != c("prev_tone")), "tone_changed"),
    ]
    noted = annotations.where("persona_type <> ''").join(drift(decisions), "user_id")
    return out.unionAll(noted.select("user_id", F.explode(F.array_compact(F.array(*rules))).alias("rule")))


#: Tags of a choice that lean one way.
FRUGAL_TAGS = ["成本观", "性价比优先", "独立性", "动手派", "省钱"]
SPEND_TAGS = ["愿意投入", "花钱", "付费"]


def persona_alerts(choices: DataFrame, personas: DataFrame) -> DataFrame:
    """(user_id, ts, event_id, alerts): choices that speak against a user's persona text, or show that it is stale.

    ``choices`` (user_id, ts, event_id, direction, tags), ``personas`` (user_id, text). For 24 hours
    after an alert a user's further ones are dropped; this folds a user's alerts in one row.
    """
    t, p, c = lexicon.DRIFT, F.col("text"), F.col
    frugal, spend, drift_ = (text.any_hit(p, ws) for ws in (t["frugal"], t["spend"], t["give_up"] + t["compromise"] + t["annoyed"]))
    rules = [
        F.when((c("direction") == "spend") & frugal, "spending_against_persona"),
        F.when((c("direction") == "frugal") & spend, "frugal_against_persona"),
        F.when((c("direction") == "drift") & drift_, "giving_up"),
        F.when(text.any_hit(c("tags"), FRUGAL_TAGS) & ~frugal, "stale_persona_frugal"),
        F.when(text.any_hit(c("tags"), SPEND_TAGS) & ~spend, "stale_persona_spend"),
    ]
    found = choices.join(personas, "user_id").select("user_id", F.struct("ts", "event_id", F.array_compact(F.array(*rules)).alias("alerts")).alias("x")).where(F.size("x.alerts") > 0)
    cooled = F.expr("aggregate(_a, slice(_a, 1, 0), (k, x) -> CASE WHEN size(k) = 0 OR x.ts >= get(k, size(k) - 1).ts + INTERVAL 24 HOURS THEN concat(k, array(x)) ELSE k END)")
    return found.groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("_a")).select("user_id", F.inline(cooled))


def persona(docs: DataFrame, patterns: dict[str, str | list[str]], least: int = 2, most: int = 5) -> DataFrame:
    """The most frequent finds of each category's patterns (their first group), trimmed, 2 to 30 characters."""

    def of(category: str, pattern: str) -> Column:
        return F.transform(text.matches(F.col("text"), pattern, 1), lambda x: F.struct(F.lit(category).alias("category"), F.lower(F.trim(x)).alias("hit")))

    finds = F.flatten(F.array(*[of(c, p) for c, ps in patterns.items() for p in ([ps] if isinstance(ps, str) else ps)]))
    g = docs.select(F.inline(finds)).where("length(hit) between 2 and 30").groupBy("category", "hit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = W.partitionBy("category").orderBy(F.desc("n"), "hit")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def set_diff(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """What two versions of a set of hashes share, lost and gained."""
    a, b = old.select(column).distinct().withColumn("_a", F.lit(1)), new.select(column).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, column, "full").select(column, state.alias("state"))


def sessions(events: DataFrame, key: str, gap_minutes: int) -> DataFrame:
    """Sessions under each key: a gap of more than ``gap_minutes`` starts a new one."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    new = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) > 60 * gap_minutes).cast("int")
    s = events.withColumn("_n", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("_n").over(w))
    return s.groupBy(key, "session").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def share_of(c: Column, total: Column) -> Column:
    return F.when(total > 0, c / total).otherwise(0.0)


# Decisions of a direction from which its outline counts as formed, and the bounds of the tones of mood entropy.
FORMED = {"frugal": 50, "spend": 50, "drift": 30}
RESTLESS, CALM = 1.2, 0.5


def reminders(messages: DataFrame, decisions: DataFrame, moods: DataFrame, key: str = "user_id", formed: dict[str, int] | None = None) -> DataFrame:
    """(key, direction, drift, decisions, formed, tone): what to remind of, by rules alone.

    For keys with five messages and two decisions or more whose majority has a direction: whether so many
    decisions have formed an outline, and the tone that the entropy of the moods asks for (quiet above 1.2,
    warm below 0.5, else even; without moods the entropy is 0).
    """
    spoke = messages.groupBy(key).agg(F.count("*").alias("_m")).where("_m >= 5")
    d = drift(decisions, key).where("decisions >= 2 and majority <> 'neutral'")
    e = entropy(moods, [key], "mood").select(key, "entropy")
    limit = F.coalesce(*[F.when(F.col("majority") == k, n) for k, n in (formed or FORMED).items()], F.lit(50))
    mood = F.coalesce("entropy", F.lit(0.0))
    tone = F.when(mood > RESTLESS, "quiet").when(mood < CALM, "warm").otherwise("even")
    return d.join(spoke, key).join(e, key, "left").select(key, F.col("majority").alias("direction"), "drift", "decisions", (F.col("decisions") >= limit).alias("formed"), tone.alias("tone"))


def briefs(decisions: DataFrame, key: str = "user_id", scenes: int = 3, recent: int = 3) -> DataFrame:
    """One row for each key's stage: how many decisions, their drift and direction, its first scenes by number, its latest decisions, and the stage before."""
    keys = [key, "stage"]
    votes = [F.count_if(F.col("direction") == x).alias(f"_{x}") for x in ("frugal", "spend", "drift", "neutral")]
    latest = F.expr(f"array_join(transform(slice(sort_array(collect_list(struct(ts, event_id)), false), 1, {recent}), x -> x.event_id), ',')")
    w = W.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    few = decisions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent).groupBy(*keys).agg(latest.alias("latest"))  # a few rows a stage are collected
    g = decisions.groupBy(*keys).agg(F.count("*").alias("decisions"), F.sum("drift").cast("long").alias("drift"), *votes)
    best = F.greatest("_frugal", "_spend", "_drift", "_neutral")
    major = F.when(F.col("_frugal") == best, "frugal").when(F.col("_spend") == best, "spend").when(F.col("_drift") == best, "drift").otherwise("neutral")
    n = decisions.groupBy(*keys, "scene").agg(F.count("*").alias("_n"))
    ranked = n.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "scene"))).where(F.col("_r") <= scenes)
    top = ranked.groupBy(*keys).agg(F.expr("array_join(transform(sort_array(collect_list(struct(_r, scene))), x -> x.scene), ',')").alias("scenes"))
    before = F.lag("stage").over(W.partitionBy(key).orderBy("stage"))
    return g.join(top, keys).join(few, keys).select(*keys, before.alias("before"), "decisions", "drift", major.alias("direction"), "scenes", "latest")
