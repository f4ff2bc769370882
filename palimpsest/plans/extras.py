"""Registered queries over small state, further text rules and composed reads, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, graph, log, memory, retrieval, state
from . import said
from . import views as v
from .behaviour import _STAMP
from .catalog import _ASKED_SQL, _WORDS_SQL, asked

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: The SQL of a query over all messages and the stated ones, over the messages alone.
_OVER = lambda name: said.SQL[name].replace("FROM said", "FROM messages")


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "entity_route",
    f"""WITH {v.CORPUS}, {_ASKED_SQL}, {v.FEEDBACK}, trust AS (SELECT msg_id, list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN helpful THEN 0.05::DOUBLE ELSE -0.10::DOUBLE END ORDER BY seq)), lambda t, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, t + x))) AS trust FROM feedback GROUP BY msg_id),
e AS (SELECT DISTINCT msg_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) AS name FROM corpus), q AS (SELECT DISTINCT query_id, unnest({_WORDS_SQL}) AS word FROM asked),
m AS (SELECT query_id, min(name) AS name FROM q JOIN e ON length(word) >= 4 AND contains(name, word) GROUP BY query_id), h AS (SELECT query_id, msg_id FROM m JOIN e USING (name))
SELECT query_id, msg_id, round(coalesce(trust, 0.5), 6) AS score FROM h LEFT JOIN trust USING (msg_id)""",
)
def _(s, d):
    e = v.corpus(s, d).select("msg_id", F.explode(text.matches(F.col("text"), "[A-Z][a-z]+ [A-Z][a-z]+")).alias("name")).select("msg_id", F.lower("name").alias("name")).distinct()
    q = asked(s, d).select("query_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word")).where("length(word) >= 4")
    first = e.select("name").distinct().join(F.broadcast(q), F.contains("name", "word")).groupBy("query_id").agg(F.min("name").alias("name"))
    trust = retrieval.trust_fold(v.feedback(s, d)).select("msg_id", "trust")
    return e.join(first, "name").join(trust, "msg_id", "left").select("query_id", "msg_id", F.round(F.coalesce("trust", F.lit(0.5)), 6).alias("score"))


@query(
    "full_scan_fallback",
    f"""WITH {v.CORPUS}, {_ASKED_SQL}, t AS (SELECT query_id, text AS whole, {_WORDS_SQL} AS ws FROM asked)
SELECT query_id, msg_id, CASE WHEN contains(lower(c.text), whole) THEN 0 ELSE 1 END AS tier, len(list_filter(ws, lambda w: contains(lower(c.text), w)))::INT AS hits FROM corpus c, t WHERE len(list_filter(ws, lambda w: contains(lower(c.text), w))) >= 2""",
)
def _(s, d):
    q = asked(s, d).select("query_id", F.col("text").alias("whole"), text.words(F.col("text")).alias("words"))
    return retrieval.substring_hits(v.corpus(s, d), q)


@query("fact_lines", f"WITH {v.CORPUS}, l AS (SELECT msg_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls FROM corpus), f AS (SELECT msg_id, list_filter(ls, lambda x: regexp_matches(x, '(tion|ment|heit)') AND NOT regexp_matches(x, '^(The|Une|Der)') AND length(x) >= 6)[1:10] AS fs FROM l) SELECT msg_id, len(fs)::INT AS n, md5(array_to_string(fs, '|')) AS digest FROM f")
def _(s, d):
    f = v.corpus(s, d).select("msg_id", text.fact_lines(F.col("text"), "(tion|ment|heit)", "^(The|Une|Der)").alias("fs"))
    return f.select("msg_id", F.size("fs").alias("n"), F.md5(F.array_join("fs", "|")).alias("digest"))


@query("choice_chain", None)
def _(s, d):
    return v.messages(s, d).select("msg_id", text.choice_chain(F.col("text")).alias("c")).select("msg_id", F.size("c").alias("n"), text.chain_summary(F.col("c")).alias("summary"))


@query("message_facts", _OVER("said_facts"))
def _(s, d):
    return v.messages(s, d).select("msg_id", F.inline(text.facts(F.col("text"))))


@query("relation_triples", _OVER("said_triples"))
def _(s, d):
    return graph.extract(v.messages(s, d))


@query("decision_filter", _OVER("said_decisions"))
def _(s, d):
    return v.messages(s, d).select("msg_id", text.is_decision(F.col("text")).alias("is_decision"))


@query("offset_chart", f"WITH {v.DECISIONS}, g AS (SELECT stage, sum(drift)::BIGINT AS drift FROM decisions GROUP BY 1) SELECT stage, drift, CASE WHEN drift < 0 THEN '-' ELSE '+' END || repeat('█', least(40, floor(abs(drift) / 1000.0))::INT) AS bar FROM g")
def _(s, d):
    g = v.decisions(s, d).groupBy("stage").agg(F.sum("drift").alias("drift"))
    return g.select("stage", "drift", state.chart(F.col("drift"), 1000.0).alias("bar"))


@query("stage_list", f"WITH {v.DECISIONS} SELECT stage, count(*) AS n, {_STAMP.format('min(ts)')} AS first_seen, {_STAMP.format('max(ts)')} AS last_seen FROM decisions GROUP BY stage")
def _(s, d):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return state.stages(v.decisions(s, d)).select("stage", "n", f("first_seen"), f("last_seen"))


@query("task_latest", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(s, d):
    o = v.read(s, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return state.latest(o, "custkey", ["o_orderdate", "orderkey"]).drop("o_orderdate")


@query("rules_ranked", "WITH r AS (SELECT * FROM (VALUES (1, 'view'), (2, 'click'), (3, 'refund'), (4, 'error')) t(pos, rule)) SELECT pos, rule, (SELECT count(*) FROM events WHERE event_type = rule) AS uses FROM r ORDER BY uses DESC, pos LIMIT 3")
def _(s, d):
    r = s.createDataFrame([(1, "view"), (2, "click"), (3, "refund"), (4, "error")], "pos int, rule string")
    return state.rank_rules(r, v.read(s, d, "events").select(F.col("event_type").alias("rule")), 3).select("pos", "rule", "uses")


@query(
    "drift_acceleration",
    f"""WITH {v.DECISIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM decisions),
g AS (SELECT user_id, round(avg(drift) FILTER (WHERE r <= 5), 6) AS recent, round(avg(drift) FILTER (WHERE r > 5 AND r <= 20), 6) AS earlier FROM r GROUP BY 1) SELECT *, coalesce(abs(recent) > abs(earlier), false) AS speeds_up FROM g""",
)
def _(s, d):
    return state.acceleration(v.decisions(s, d), "user_id", ["ts", "event_id"], "drift")


@query("annotation_due", f"WITH {v.MESSAGES} SELECT conv_id, msg_id, row_number() OVER (PARTITION BY conv_id ORDER BY msg_id) AS n FROM messages QUALIFY n % 3 = 0")
def _(s, d):
    return state.annotate_due(v.messages(s, d), 3).select("conv_id", "msg_id", F.col("n").cast("long").alias("n"))


@query("health_report", "SELECT 'events' AS \"table\", count(*) AS n, count(*) FILTER (WHERE event_id IS NULL OR ts IS NULL OR user_id IS NULL) AS with_nulls FROM events UNION ALL SELECT 'labels', count(*), count(*) FILTER (WHERE doc_id IS NULL OR quality IS NULL OR toxic IS NULL) FROM labels")
def _(s, d):
    return state.health({"events": v.read(s, d, "events").select("event_id", "ts", "user_id"), "labels": v.read(s, d, "labels")})


@query("log_month_search", f"WITH {v.MESSAGES} SELECT msg_id, sender FROM messages WHERE contains(lower(text), 'the') AND strftime(ts, '%Y-%m') = '2024-01'")
def _(s, d):
    return log.substring_scan(v.messages(s, d), "the", month="2024-01").select("msg_id", "sender")


@query("memory_supersede", f"WITH {v.MEMORIES}, w AS (SELECT type, arg_max(memory_id, (weight, memory_id)) AS keeper FROM memories GROUP BY type) SELECT memory_id, CASE WHEN memory_id <> keeper AND weight < 0.25 THEN keeper END AS superseded_by FROM memories JOIN w USING (type) WHERE memory_id <> keeper AND weight < 0.25")
def _(s, d):
    m = v.memories(s, d).select("memory_id", "type", "weight")
    w = m.groupBy("type").agg(F.max_by("memory_id", F.struct("weight", "memory_id")).alias("superseded_by"))
    return m.join(w, "type").where("memory_id <> superseded_by and weight < 0.25").select("memory_id", "superseded_by")


_FIELDS = ("tion", "heit", "mente", "eau")


@query(
    "persona_triggers",
    f"""WITH {v.MEMORIES}, f AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(_FIELDS))}) t(pos, field))
SELECT memory_id, arg_min(field, pos) AS field FROM memories JOIN f ON contains(lower(content), field) WHERE type = 'semantic' GROUP BY memory_id""",
)
def _(s, d):
    f = s.createDataFrame(list(enumerate(_FIELDS)), "pos int, field string")
    m = v.memories(s, d).where("type = 'semantic'").select("memory_id", F.lower("content").alias("_c")).join(F.broadcast(f), F.contains("_c", "field"))
    return m.groupBy("memory_id").agg(F.min_by("field", "pos").alias("field"))


@query(
    "nightly_report",
    f"""WITH {v.MEMORIES}, a AS (SELECT *, epoch(TIMESTAMP '2024-03-01' - created_at) / 86400.0 AS age FROM memories)
SELECT type, count(*) AS n, count(*) FILTER (WHERE type IN ('episodic', 'emotional') AND age >= 45) AS idle, count(*) FILTER (WHERE type = 'emotional' AND arousal >= 0.5) AS inspiring, round(sum(weight), 6) AS weight FROM a GROUP BY type""",
)
def _(s, d):
    m = memory.age_and_demote(v.memories(s, d), "2024-03-01 00:00:00", idle_days=45, archive_days=10_000)
    return m.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("fate") == "demote").alias("idle"), F.count_if((F.col("type") == "emotional") & (F.col("arousal") >= 0.5)).alias("inspiring"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    "mood_before_decision",
    f"""WITH {v.DECISIONS}, {v.MOODS}, l AS (SELECT d.event_id, d.user_id, d.ts, max((m.ts, m.event_id, m.mood)) AS x FROM decisions d JOIN moods m ON m.user_id = d.user_id AND (m.ts, m.event_id) < (d.ts, d.event_id) WHERE d.direction = 'drift' GROUP BY ALL)
SELECT event_id, user_id, x[3] AS mood FROM l WHERE x[1] > ts - INTERVAL 1 DAY""",
)
def _(s, d):
    # as-of read: one window over the user's rows instead of a range join
    both = v.moods(s, d).select("user_id", "ts", "event_id", F.struct("ts", "mood").alias("m")).join(v.decisions(s, d).select("event_id", "direction"), "event_id")
    before = F.last("m").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    got = both.withColumn("l", before).where("direction = 'drift' and l.ts > ts - interval 1 day")
    return got.select("event_id", "user_id", F.col("l.mood").alias("mood"))


@query("wind_by_day", f"WITH {v.MOODS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(valence), 6) AS wind FROM moods GROUP BY 1")
def _(s, d):
    return v.moods(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("valence"), 6).alias("wind"))


@query("scene_pivot", f"WITH {v.DECISIONS} SELECT stage, " + ", ".join(f"count(*) FILTER (WHERE scene = 's{k}') AS s{k}" for k in range(5)) + " FROM decisions GROUP BY stage")
def _(s, d):
    scenes = [f"s{k}" for k in range(5)]
    return v.decisions(s, d).groupBy("stage").agg(*[F.count_if(F.col("scene") == x).alias(x) for x in scenes])


@query("drift_entropy_mode", f"WITH {v.DECISIONS}, c AS (SELECT user_id, direction, count(*) AS c FROM decisions GROUP BY ALL), p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c), e AS (SELECT user_id, round(-sum(p * ln(p)), 4) + 0.0 AS entropy FROM p GROUP BY 1), g AS (SELECT user_id, round(avg(drift), 6) AS drift FROM decisions GROUP BY 1) SELECT user_id, entropy, drift, CASE WHEN entropy > 1.0 AND abs(drift) > 10 THEN 'emotional' WHEN entropy < 0.3 AND abs(drift) < 5 THEN 'exam' ELSE 'normal' END AS mode FROM e JOIN g USING (user_id)")
def _(s, d):
    dec = v.decisions(s, d)
    e = analytics.entropy(dec, ["user_id"], "direction").select("user_id", "entropy")
    g = dec.groupBy("user_id").agg(F.round(F.avg("drift"), 6).alias("drift"))
    mode = F.when((F.col("entropy") > 1.0) & (F.abs("drift") > 10), "emotional").when((F.col("entropy") < 0.3) & (F.abs("drift") < 5), "exam").otherwise("normal")
    return e.join(g, "user_id").withColumn("mode", mode)
