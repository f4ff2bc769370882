"""Registered queries that compose operators: restricted search, scenes and stages, persona upkeep, migration."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import analytics, blockmax, graph, replica, retrieval, spans, state, vectors, vocabulary
from ..sources.shared import shared_dir
from . import said
from . import views as v
from .behaviour import _SPANS
from .behaviour import SQL as _BEHAVIOUR
from .catalog import _ASKED_SQL, _WORDS_SQL, _at

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TOKENS = f"postings AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS token, msg_id FROM corpus), qtokens AS (SELECT DISTINCT query_id, unnest({_WORDS_SQL}) AS token FROM asked)"


@query("search_in_source", f"WITH {v.CORPUS}, {_ASKED_SQL}, {_TOKENS}, n AS (SELECT query_id, count(*) AS n FROM qtokens GROUP BY 1), h AS (SELECT query_id, msg_id, count(*) AS hits FROM postings JOIN qtokens USING (token) JOIN corpus USING (msg_id) WHERE source = 'src1' GROUP BY ALL) SELECT query_id, msg_id, hits FROM h JOIN n USING (query_id) WHERE hits * 2 >= n")
def _(s, d):
    c = v.corpus(s, d).where("source = 'src1'")
    at = _at(s, d)
    hits = retrieval.postings(c, text.words(F.col("text"))).join(F.broadcast(at), "token").groupBy("query_id", "msg_id").agg(F.count("*").alias("hits"))
    return hits.join(F.broadcast(at.groupBy("query_id").agg(F.count("*").alias("n"))), "query_id").where("hits * 2 >= n").select("query_id", "msg_id", "hits")


@query("scene_guess", f"WITH {v.MESSAGES}, t AS (SELECT conv_id, text FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY msg_id DESC) <= 15), k AS (SELECT * FROM (VALUES ('work', 'tion'), ('work', 'ment'), ('home', 'heit'), ('travel', 'mente')) k(scene, word)) SELECT DISTINCT conv_id, scene FROM t JOIN k ON contains(lower(text), word)")
def _(s, d):
    k = s.createDataFrame([("work", "tion"), ("work", "ment"), ("home", "heit"), ("travel", "mente")], "scene string, word string")
    w = W.partitionBy("conv_id").orderBy(F.desc("msg_id"))
    tail = v.messages(s, d).withColumn("_r", F.row_number().over(w)).where("_r <= 15").select("conv_id", F.lower("text").alias("_t"))
    return tail.join(F.broadcast(k), F.contains("_t", "word")).select("conv_id", "scene").distinct()


@query(
    "scene_cross_validate",
    f"""WITH {v.DECISIONS}, s AS (SELECT DISTINCT stage, scene FROM decisions WHERE abs(drift) >= 100), p AS (SELECT a.stage AS stage_a, b.stage AS stage_b FROM (SELECT DISTINCT stage FROM s) a JOIN (SELECT DISTINCT stage FROM s) b ON a.stage < b.stage)
SELECT stage_a, stage_b, (SELECT count(*) FROM (SELECT scene FROM s WHERE stage = stage_a INTERSECT SELECT scene FROM s WHERE stage = stage_b)) AS common, (SELECT count(*) FROM (SELECT scene FROM s WHERE stage = stage_a EXCEPT SELECT scene FROM s WHERE stage = stage_b)) AS only_a, (SELECT count(*) FROM (SELECT scene FROM s WHERE stage = stage_b EXCEPT SELECT scene FROM s WHERE stage = stage_a)) AS only_b FROM p""",
)
def _(s, d):
    x = v.decisions(s, d).where("abs(drift) >= 100").groupBy("stage").agg(F.collect_set("scene").alias("x"))  # stages and scenes are few
    p = x.select(F.col("stage").alias("stage_a"), F.col("x").alias("a")).join(x.select(F.col("stage").alias("stage_b"), F.col("x").alias("b")), F.col("stage_a") < F.col("stage_b"))
    n = lambda c: F.size(c).cast("long")
    return p.select("stage_a", "stage_b", n(F.array_intersect("a", "b")).alias("common"), n(F.array_except("a", "b")).alias("only_a"), n(F.array_except("b", "a")).alias("only_b"))


@query(
    "cross_stage_evolution",
    f"""WITH {v.DECISIONS}, c AS (SELECT user_id, stage, direction, count(*) AS n FROM decisions WHERE direction <> 'neutral' GROUP BY ALL), m AS (SELECT user_id, stage, direction FROM c QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY n DESC, direction) = 1)
SELECT user_id, arg_min(direction, stage) AS first_direction, arg_max(direction, stage) AS last_direction, arg_min(direction, stage) <> arg_max(direction, stage) AS evolved, count(*) AS stages FROM m GROUP BY user_id""",
)
def _(s, d):
    c = v.decisions(s, d).where("direction <> 'neutral'").groupBy("user_id", "stage", "direction").agg(F.count("*").alias("n"))
    w = W.partitionBy("user_id", "stage").orderBy(F.desc("n"), "direction")
    m = c.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    g = m.groupBy("user_id").agg(F.min_by("direction", "stage").alias("first_direction"), F.max_by("direction", "stage").alias("last_direction"), F.count("*").alias("stages"))
    return g.withColumn("evolved", F.col("first_direction") != F.col("last_direction"))


@query("persona_project", f"WITH {v.DECISIONS}, g AS (SELECT user_id, avg(drift) AS m, count(*) FILTER (WHERE direction = 'frugal') AS f, count(*) FILTER (WHERE direction = 'spend') AS s FROM decisions GROUP BY 1) SELECT user_id, CASE WHEN m >= 0 THEN 'frugal' ELSE 'spend' END AS leaning, CASE WHEN m >= 0 THEN s ELSE f END AS opposed, round(least(2 * abs(m), 100.0), 6) AS divergence FROM g")
def _(s, d):
    g = v.decisions(s, d).groupBy("user_id").agg(F.avg("drift").alias("m"), F.count_if(F.col("direction") == "frugal").alias("f"), F.count_if(F.col("direction") == "spend").alias("s"))
    up = F.col("m") >= 0
    return g.select("user_id", F.when(up, "frugal").otherwise("spend").alias("leaning"), F.when(up, F.col("s")).otherwise(F.col("f")).alias("opposed"), F.round(F.least(2 * F.abs("m"), F.lit(100.0)), 6).alias("divergence"))


@query("persona_freshness", f"WITH {v.MESSAGES}, g AS (SELECT sender, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-03-01') AS fresh FROM messages GROUP BY 1) SELECT sender, fresh, CASE WHEN fresh < 30 THEN 'fresh' WHEN fresh < 80 THEN 'ageing' ELSE 'stale' END AS band FROM g")
def _(s, d):
    g = v.messages(s, d).groupBy("sender").agg(F.count_if(F.col("ts") >= F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("fresh"))
    return g.withColumn("band", F.when(F.col("fresh") < 30, "fresh").when(F.col("fresh") < 80, "ageing").otherwise("stale"))


@query(
    "entropy_mirror",
    f"""WITH {v.CORPUS}, {_ASKED_SQL}, {_TOKENS}, h AS (SELECT query_id, msg_id, count(*) AS hits FROM postings JOIN qtokens USING (token) GROUP BY ALL), t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, msg_id) <= 5)
SELECT query_id, lang, count(*) AS n FROM t JOIN corpus USING (msg_id) GROUP BY ALL""",
)
def _(s, d):
    c = v.corpus(s, d)
    near = blockmax.count_match(v.stored(s, d), _at(s, d), 5)
    return near.join(c.select("msg_id", "lang"), "msg_id").groupBy("query_id", "lang").agg(F.count("*").alias("n"))


@query("vector_latest", "WITH u AS (SELECT vec_id % 100 AS id, vec_id AS seq, label FROM embeddings) SELECT id, seq, label FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def _(s, d):
    u = v.read(s, d, "embeddings").select((F.col("vec_id") % 100).alias("id"), F.col("vec_id").alias("seq"), "label")
    return state.latest(u, "id", ["seq"])


@query("line_migration", f"WITH {v.MESSAGES}, e AS (SELECT msg_id, CASE WHEN msg_id % 2 = 0 THEN to_base64(encode(text)) ELSE text END AS line FROM messages), c AS (SELECT msg_id, regexp_full_match(line, '[A-Za-z0-9+/]+={{0,2}}') AND length(line) % 4 = 0 AS packed, line FROM e) SELECT CASE WHEN packed THEN 'base64' ELSE 'plain' END AS class, count(*) AS n, sum(length(CASE WHEN packed THEN decode(from_base64(line)) ELSE line END))::BIGINT AS chars FROM c GROUP BY 1")
def _(s, d):
    line = F.when(F.col("msg_id") % 2 == 0, F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")).otherwise(F.col("text"))
    packed = F.col("line").rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length("line") % 4 == 0)
    c = v.messages(s, d).select(line.alias("line")).withColumn("packed", packed)
    plain = F.when(F.col("packed"), F.decode(F.unbase64(F.when(F.col("packed"), F.col("line"))), "UTF-8")).otherwise(F.col("line"))
    return c.groupBy(F.when(F.col("packed"), "base64").otherwise("plain").alias("class")).agg(F.count("*").alias("n"), F.sum(F.length(plain)).alias("chars"))


@query("trailing_means", f"WITH {v.DECISIONS} SELECT event_id, user_id, round(avg(drift) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM decisions")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return v.decisions(s, d).select("event_id", "user_id", F.round(F.avg("drift").over(w), 6).alias("mean5"))


@query("learned_tags", f"WITH {v.DECISIONS}, seen AS (SELECT DISTINCT scene || direction AS tag FROM decisions WHERE stage < 4) SELECT DISTINCT scene || direction AS tag FROM decisions WHERE stage >= 4 AND scene || direction NOT IN (SELECT tag FROM seen)")
def _(s, d):
    t = v.decisions(s, d).withColumn("tag", F.concat("scene", "direction"))
    seen = t.where("stage < 4").select("tag").distinct()
    return t.where("stage >= 4").select("tag").distinct().join(seen, "tag", "left_anti")


_TAG = "user_id || ':' || scene || direction"


@query("learned_tags_by_user", f"WITH {v.DECISIONS}, seen AS (SELECT DISTINCT {_TAG} AS tag FROM decisions WHERE stage < 3) SELECT DISTINCT {_TAG} AS tag FROM decisions WHERE stage >= 3 AND {_TAG} NOT IN (SELECT tag FROM seen)")
def _(s, d):
    t = v.decisions(s, d).withColumn("tag", F.concat("user_id", F.lit(":"), "scene", "direction"))
    seen = t.where("stage < 3").select("tag").distinct()
    return t.where("stage >= 3").select("tag").distinct().join(seen, "tag", "left_anti")


@query("message_signals", said.SQL["said_signals"].replace("FROM said WHERE", "FROM messages WHERE"))
def _(s, d):
    from ..streaming.ingest import decorate

    return decorate(v.messages(s, d)).select("msg_id", "is_decision", "mood", "memory_type", "drift")


@query("stability_overall", f"WITH {v.DECISIONS}, g AS (SELECT user_id, count(*) AS n, round(stddev_samp(drift), 4) AS deviation FROM decisions GROUP BY 1 HAVING count(*) >= 5) SELECT *, CASE WHEN deviation < 15 THEN 'steady' WHEN deviation < 30 THEN 'mild' WHEN deviation < 50 THEN 'swinging' ELSE 'wild' END AS band FROM g")
def _(s, d):
    return analytics.stability(v.decisions(s, d), ["user_id"], 5)


# ---------------------------------------------------------------- learnt words, vector lists

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_LIST = lambda xs: "[" + ", ".join(map(_QUOTED, xs)) + "]"


@query(
    "learnt_moods",
    f"""WITH {v.CORPUS}, w0 AS (SELECT DISTINCT lower(word) AS word, mood, 0 AS version FROM (VALUES {', '.join(f'({_QUOTED(w)}, {_QUOTED(m)})' for m in lexicon.MOOD_ORDER for w in lexicon.MOODS[m])}) t(word, mood)),
wl AS (SELECT word, {_LIST(lexicon.MOOD_ORDER)}[item_id % 7 + 1] AS mood, min(5 * item_id) AS version FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS word FROM benchmark) GROUP BY ALL),
w AS (SELECT word, list_position({_LIST(lexicon.MOOD_ORDER)}, mood) AS rank, version FROM (SELECT * FROM w0 UNION ALL SELECT * FROM wl ANTI JOIN w0 USING (word, mood))),
h AS (SELECT msg_id, rank, word, low, instr(low, word) AS pos FROM (SELECT msg_id, lower(text) AS low FROM corpus) JOIN w ON version <= msg_id AND contains(low, word)),
k AS (SELECT * FROM h WHERE rank <> {lexicon.MOOD_ORDER.index(lexicon.HAPPY) + 1} OR len(list_filter({_LIST(lexicon.NEGATORS)}, lambda n: contains(substring(low, greatest(pos - 8, 1), pos - greatest(pos - 8, 1)), n))) = 0),
g AS (SELECT msg_id, count(DISTINCT word)::INT AS n, arg_min(rank, lpad(rank::VARCHAR, 2, '0') || lpad((1000 - length(word))::VARCHAR, 4, '0') || word) AS rank, arg_min(word, lpad(rank::VARCHAR, 2, '0') || lpad((1000 - length(word))::VARCHAR, 4, '0') || word) AS word FROM k GROUP BY msg_id)
SELECT msg_id, coalesce({_LIST(lexicon.MOOD_ORDER)}[rank], '') AS mood, coalesce(word, '') AS mood_word, coalesce(n, 0) AS mood_words FROM corpus LEFT JOIN g USING (msg_id)""",
)
def _(s, d):
    words = v.questions(s, d).select("query_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("word"))
    mood = F.element_at(F.lit(list(lexicon.MOOD_ORDER)), (F.col("query_id") % 7 + 1).cast("int"))
    vocab = vocabulary.learn(vocabulary.builtin(s), words.select("word", mood.alias("mood"), (F.col("query_id") * 5).alias("version")))
    return vocabulary.moods(v.corpus(s, d).select("msg_id", "text", F.col("msg_id").alias("version")), vocab).select("msg_id", "mood", "mood_word", "mood_words")


def _asked_vectors(s, d):
    """A stated query set: every 20th vector."""
    e = v.read(s, d, "embeddings")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("vector_index_recall", None)
def _(s, d):
    e, asked_ = _asked_vectors(s, d)
    index = vectors.Lists.build(e, f"{shared_dir(s)}/lists-{uuid.uuid4().hex}")
    return vectors.recall(index.search(asked_), vectors.exact_top(e, asked_))


@query(
    "vector_neighbours",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM c QUALIFY rank <= 10""",
)
def _(s, d):
    return vectors.exact_top(*_asked_vectors(s, d))


# ---------------------------------------------------------------- replicas, moments in intervals

_SLOT = "(conv_id * 31 + turn)"


@query(
    "replica_differences",
    f"""WITH {v.MESSAGES}, a AS (SELECT msg_id, sender, text, ts FROM messages),
b AS (SELECT msg_id, sender, CASE WHEN {_SLOT} % 89 = 5 THEN text || '!' ELSE text END AS text, ts FROM messages WHERE {_SLOT} % 97 <> 3 UNION ALL SELECT -1 - msg_id, sender, text, ts FROM messages WHERE {_SLOT} % 83 = 7)
SELECT coalesce(a.msg_id, b.msg_id) AS msg_id, CASE WHEN b.msg_id IS NULL THEN 'missing' WHEN a.msg_id IS NULL THEN 'added' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.msg_id = b.msg_id WHERE a.msg_id IS NULL OR b.msg_id IS NULL OR a.sender IS DISTINCT FROM b.sender OR a.text IS DISTINCT FROM b.text OR a.ts IS DISTINCT FROM b.ts""",
)
def _(s, d):
    m = v.messages(s, d)
    columns = ["msg_id", "sender", "text", "ts"]
    kept = m.where(f"{_SLOT} % 97 <> 3").withColumn("text", F.when(F.expr(f"{_SLOT} % 89 = 5"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = m.where(f"{_SLOT} % 83 = 7").withColumn("msg_id", -1 - F.col("msg_id"))
    return replica.differences(m.select(columns), kept.select(columns).unionAll(more.select(columns)), "msg_id", F.date_format("ts", "yyyy-MM"))


_MICROS = "datediff({0}, date'1970-01-01') * 86400000000L + cast((hour({0}) * 3600 + minute({0}) * 60 + extract(SECOND FROM {0})) * 1000000 AS LONG)"


@query(
    "temporal_asof_many",
    f"""WITH {v.STATUS}, {_SPANS} SELECT l_orderkey, l_linenumber, object, id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN spans ON subject = o_custkey AND valid_from <= l_shipdate AND (valid_until IS NULL OR valid_until > l_shipdate)""",
)
def _(s, d):
    held = graph.intervals(v.status_facts(s, d)).select(F.col("subject").alias("o_custkey"), "object", "id", F.expr(_MICROS.format("valid_from")).alias("since"), F.expr(_MICROS.format("valid_until")).alias("until"))
    shipped = v.read(s, d, "lineitem").join(v.read(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    moments = shipped.select("o_custkey", "l_orderkey", "l_linenumber", F.expr(_MICROS.format("l_shipdate")).alias("at"))
    return spans.as_of_many(moments, held, "o_custkey", "at", "since", "until").select("l_orderkey", "l_linenumber", "object", "id")


# ---------------------------------------------------------------- reminders and briefs


def _renamed(sql: str, name: str) -> str:
    return f"{name} AS ({sql})"


@query(
    "reminders",
    f"""WITH {_renamed(_BEHAVIOUR["drift_comprehensive"], "dr")}, {_renamed(_BEHAVIOUR["mood_entropy"], "en")}, sp AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 5)
SELECT user_id, majority AS direction, drift, decisions, decisions >= CASE majority WHEN 'drift' THEN 30 ELSE 50 END AS formed, CASE WHEN entropy > 1.2 THEN 'quiet' WHEN coalesce(entropy, 0) < 0.5 THEN 'warm' ELSE 'even' END AS tone
FROM dr JOIN sp USING (user_id) LEFT JOIN en USING (user_id) WHERE decisions >= 2 AND majority <> 'neutral'""",
)
def _(s, d):
    return analytics.reminders(v.read(s, d, "events"), v.decisions(s, d), v.moods(s, d))


@query(
    "stage_briefs",
    f"""WITH {v.DECISIONS}, g AS (SELECT user_id, stage, count(*) AS decisions, sum(drift)::BIGINT AS drift, count(*) FILTER (direction = 'frugal') AS a, count(*) FILTER (direction = 'spend') AS b, count(*) FILTER (direction = 'drift') AS c, count(*) FILTER (direction = 'neutral') AS e FROM decisions GROUP BY ALL),
c3 AS (SELECT user_id, stage, scene, count(*) AS c FROM decisions GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, stage ORDER BY c DESC, scene) AS r FROM c3 QUALIFY r <= 3), t AS (SELECT user_id, stage, string_agg(scene, ',' ORDER BY r) AS scenes FROM n GROUP BY ALL),
f AS (SELECT user_id, stage, event_id, row_number() OVER (PARTITION BY user_id, stage ORDER BY ts DESC, event_id DESC) AS r FROM decisions QUALIFY r <= 3), l AS (SELECT user_id, stage, string_agg(event_id::VARCHAR, ',' ORDER BY r) AS latest FROM f GROUP BY ALL)
SELECT user_id, stage, coalesce(lag(stage) OVER (PARTITION BY user_id ORDER BY stage), -1)::INT AS before, decisions, drift, CASE greatest(a, b, c, e) WHEN a THEN 'frugal' WHEN b THEN 'spend' WHEN c THEN 'drift' ELSE 'neutral' END AS direction, scenes, latest
FROM g JOIN t USING (user_id, stage) JOIN l USING (user_id, stage)""",
)
def _(s, d):
    return analytics.briefs(v.decisions(s, d)).withColumn("before", F.coalesce("before", F.lit(-1)))
