"""Registered queries over facts, memories, sketches and behaviour, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, graph, memory, retrieval, sketches
from . import views as v
from .catalog import _ASKED_SQL, _LONGEST_SQL, _VQ, _WORDS_SQL, _vq, longest_words, stamp

QUERIES: dict = {}
SQL: dict[str, str] = {}
MOMENT = "1996-06-01 00:00:00"
NOW = "2024-03-01 00:00:00"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- facts


@query("triples_insert_absent", f"WITH {v.EDGES} SELECT DISTINCT subject, relation, object FROM edges WHERE relation = 'placed' EXCEPT SELECT subject, relation, object FROM edges WHERE subject < 'c2'")
def _(s, d):
    e = v.edges(s, d)
    return graph.insert_absent(e.where("subject < 'c2'"), e.where("relation = 'placed'"))


@query("graph_neighbors", f"WITH {v.EDGES}, u AS (SELECT subject AS entity, relation, object AS other, 'out' AS way FROM edges UNION ALL SELECT object, relation, subject, 'in' FROM edges) SELECT * FROM u WHERE entity = 'n3'")
def _(s, d):
    return graph.neighbours(v.edges(s, d), "n3")


@query(
    "graph_two_hop",
    f"""WITH {v.EDGES}, u AS (SELECT subject AS entity, relation, object AS other FROM edges UNION ALL SELECT object, relation, subject FROM edges), f AS (SELECT * FROM u WHERE entity = 'c7'),
s AS (SELECT u.* FROM u JOIN (SELECT DISTINCT other FROM f) n ON u.entity = n.other QUALIFY row_number() OVER (PARTITION BY u.entity ORDER BY u.relation DESC, u.other DESC) <= 5)
SELECT 1 AS hop, entity, relation, other FROM f UNION ALL SELECT 2, entity, relation, other FROM s""",
)
def _(s, d):
    return graph.two_hops(v.edges(s, d), "c7")


@query(
    "graph_khop",
    f"""WITH RECURSIVE {v.EDGES}, r(node, distance) AS (SELECT 'c7', 0 UNION SELECT e.object, distance + 1 FROM r JOIN edges e ON e.subject = r.node WHERE distance < 3)
SELECT node, min(distance)::INT AS distance FROM r GROUP BY node""",
)
def _(s, d):
    return graph.reach(v.edges(s, d), "c7", 3)


@query("graph_stats", f"WITH {v.EDGES} SELECT relation, count(*) AS triples, (SELECT count(*) FROM (SELECT subject FROM edges UNION SELECT object FROM edges)) AS entities FROM edges GROUP BY relation")
def _(s, d):
    return graph.stats(v.edges(s, d))


@query("graph_summary", f"WITH {v.EDGES}, r AS (SELECT DISTINCT subject, relation, object FROM edges), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY subject, relation ORDER BY object) <= 3) SELECT subject, relation, string_agg(object, ', ' ORDER BY object) AS targets FROM t GROUP BY ALL")
def _(s, d):
    return graph.summary(v.edges(s, d))


@query("fact_conflicts", f"WITH {v.STATUS} SELECT id, subject, object, first_value(object) OVER w AS held, CASE WHEN row_number() OVER w = 1 THEN 'stored' WHEN object = first_value(object) OVER w THEN 'confirm' ELSE 'conflict' END AS verdict FROM facts WINDOW w AS (PARTITION BY subject, relation ORDER BY ts, id)")
def _(s, d):
    return graph.first_wins(v.status_facts(s, d)).select("id", "subject", "object", "held", "verdict")


@query(
    "fact_verdicts",
    f"""WITH {v.STATUS}, known AS (SELECT DISTINCT subject, object FROM facts WHERE ts < TIMESTAMP '{MOMENT}'), claims AS (SELECT DISTINCT subject, relation, object FROM facts WHERE ts >= TIMESTAMP '{MOMENT}')
SELECT c.subject, c.relation, c.object, CASE WHEN bool_or(k.object = c.object) THEN 'confirm' WHEN count(k.object) > 0 THEN 'conflict' ELSE 'unknown' END AS verdict, count(k.object) AS known FROM claims c LEFT JOIN known k USING (subject) GROUP BY ALL""",
)
def _(s, d):
    f = v.status_facts(s, d)
    at = F.lit(MOMENT).cast("timestamp_ntz")
    return graph.verdicts(f.where(F.col("ts") < at), f.where(F.col("ts") >= at).select(*graph.KEYS).distinct())


_SPANS = "spans AS (SELECT subject, relation, object, ts AS valid_from, lead(ts) OVER (PARTITION BY subject, relation ORDER BY ts, id) AS valid_until, id FROM (SELECT * FROM facts QUALIFY lag(object) OVER (PARTITION BY subject, relation ORDER BY ts, id) IS DISTINCT FROM object))"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("temporal_intervals", f"WITH {v.STATUS}, {_SPANS} SELECT id, subject, object, {_STAMP.format('valid_from')} AS valid_from, {_STAMP.format('valid_until')} AS valid_until FROM spans")
def _(s, d):
    return graph.intervals(v.status_facts(s, d)).select("id", "subject", "object", stamp("valid_from").alias("valid_from"), stamp("valid_until").alias("valid_until"))


@query("temporal_asof", f"WITH {v.STATUS}, {_SPANS} SELECT id, subject, object FROM spans WHERE valid_from <= TIMESTAMP '{MOMENT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{MOMENT}')")
def _(s, d):
    return graph.as_of(graph.intervals(v.status_facts(s, d)), MOMENT).select("id", "subject", "object")


_TRACE_STEP = """h{k} AS (SELECT n.root, min(w.msg_id) AS msg_id FROM n{p} n JOIN ws w ON w.word = n.word AND w.msg_id > n.msg_id GROUP BY n.root),
n{k} AS (SELECT h.root, {k} AS hop, (max_by(w.word, lpad(length(w.word)::VARCHAR, 6, '0') || w.word)) AS word, h.msg_id FROM h{k} h JOIN ws w USING (msg_id) WHERE (h.root, w.word) NOT IN (SELECT root, word FROM a{p}) GROUP BY h.root, h.msg_id),
a{k} AS (SELECT * FROM a{p} UNION ALL SELECT * FROM n{k})"""


@query(
    "causal_trace",
    f"WITH {v.MESSAGES}, {_ASKED_SQL}, ws AS (SELECT DISTINCT msg_id, unnest({_WORDS_SQL}) AS word FROM messages), n0 AS (SELECT DISTINCT word AS root, 0 AS hop, word, 0::BIGINT AS msg_id FROM ({_LONGEST_SQL})), a0 AS (SELECT * FROM n0), "
    + ", ".join(_TRACE_STEP.format(k=k, p=k - 1) for k in (1, 2, 3))
    + " SELECT root, hop, word, msg_id FROM a3",
)
def _(s, d):
    return graph.trace(v.messages(s, d), longest_words(s, d).select("word").distinct())


# ---------------------------------------------------------------- memories

_MULT = "CASE WHEN type = 'episodic' THEN exp(-0.05::DOUBLE * 720 / (24.0 * (1 + ln(1.0 + access_count)))) WHEN type = 'emotional' THEN exp(-greatest(0.05::DOUBLE * (1 - 0.7::DOUBLE * arousal), 1e-6) * 720 / (24.0 * (1 + ln(1.0 + access_count)))) ELSE 1.0 END"


@query("mem_decay", f"WITH {v.MEMORIES} SELECT memory_id, type, round(CASE WHEN type IN ('episodic', 'emotional') THEN greatest(0.01::DOUBLE, weight * {_MULT}) ELSE weight END, 6) AS new_weight FROM memories")
def _(s, d):
    return memory.decay(v.memories(s, d), 720.0).select("memory_id", "type", "new_weight")


@query(
    "mem_surface",
    f"""WITH {v.MEMORIES}, b AS (SELECT *, CASE WHEN type = 'procedural' THEN 1 WHEN type = 'emotional' AND arousal >= 0.7 AND weight > 0.1 THEN 2 WHEN unresolved AND weight > 0.1 THEN 3
 WHEN type = 'episodic' AND epoch(TIMESTAMP '2024-01-05' - created_at) / 86400.0 <= 7 AND weight > 0.2 THEN 4 END AS bucket FROM memories)
SELECT memory_id, type, bucket FROM b WHERE bucket IS NOT NULL ORDER BY bucket, CASE WHEN bucket = 1 THEN 0 ELSE -weight END, memory_id LIMIT 150""",
)
def _(s, d):
    return memory.surface(v.memories(s, d), "2024-01-05 00:00:00", 150).select("memory_id", "type", "bucket")


@query(
    "mem_activate",
    f"""WITH {v.MEMORIES}, {_VQ}, x AS (SELECT query_id, memory_id, weight, round(list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]), 6) AS similarity FROM memories, vq)
SELECT query_id, memory_id, similarity, round(least(1.0::DOUBLE, weight + 0.05::DOUBLE * similarity), 8) AS activation, similarity >= 0.8 AS strong FROM x WHERE similarity > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(least(1.0::DOUBLE, weight + 0.05::DOUBLE * similarity), 8) DESC, memory_id) <= 30""",
)
def _(s, d):
    return memory.activate(v.memories(s, d), _vq(s, d)).select("query_id", "memory_id", "similarity", "activation", "strong")


@query(
    "mem_write_action",
    f"""WITH {v.MEMORIES}, p AS (SELECT a.memory_id AS new_id, a.type, b.memory_id AS held_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM memories a JOIN memories b USING (type) WHERE a.created_at >= TIMESTAMP '2024-01-12' AND b.created_at < TIMESTAMP '2024-01-12'),
g AS (SELECT new_id, type, max(s) AS similarity, arg_min(held_id, (-s, held_id)) AS best_id, count(*) FILTER (WHERE s >= 0.85) AS o FROM p GROUP BY ALL),
x AS (SELECT *, CASE WHEN type = 'procedural' AND similarity >= 0.9 THEN 'DEDUP' WHEN type = 'emotional' AND similarity >= 0.85 THEN 'REINFORCE' WHEN type = 'semantic' AND similarity >= 0.85 THEN 'OVERRIDE' ELSE 'INSERT' END AS action FROM g)
SELECT new_id, type, best_id, similarity, action, CASE WHEN action = 'OVERRIDE' THEN o ELSE 0 END AS overridden FROM x""",
)
def _(s, d):
    m = v.memories(s, d)
    cut = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return memory.write_actions(m.where(F.col("created_at") >= cut), m.where(F.col("created_at") < cut))


@query(
    "mem_char_jaccard",
    f"""WITH {v.MEMORIES}, c AS (SELECT memory_id, list_distinct(string_split(content, '')) AS x FROM memories), p AS (SELECT a.memory_id, a.x AS xa, b.x AS xb FROM c a JOIN c b ON b.memory_id = a.memory_id + 1)
SELECT memory_id, round(len(list_intersect(xa, xb)) / len(list_distinct(list_concat(xa, xb))), 6) AS similarity FROM p""",
)
def _(s, d):
    m = v.memories(s, d).select("memory_id", "content")
    b = m.select((F.col("memory_id") - 1).alias("memory_id"), F.col("content").alias("_c"))
    return m.join(b, "memory_id").select("memory_id", F.round(memory.char_jaccard(F.col("content"), F.col("_c")), 6).alias("similarity"))


@query("mem_reclassify", f"WITH {v.MESSAGES}, m AS (SELECT msg_id AS memory_id, regexp_replace(text, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}月\\d{{1,2}}日)\\s*', '') AS content FROM messages) SELECT content, count(*) AS n, min(memory_id) AS first_id FROM m GROUP BY content HAVING count(*) >= 3")
def _(s, d):
    m = v.messages(s, d).select(F.col("msg_id").alias("memory_id"), F.lit("episodic").alias("type"), F.col("text").alias("content"))
    return memory.reclassify(m)


_DATED = "CASE doc_id % 3 WHEN 0 THEN '2024-03-01 ' || text WHEN 1 THEN '3月1日' || text ELSE text END"


@query("mem_reclassify_documents", f"WITH m AS (SELECT doc_id AS memory_id, regexp_replace({_DATED}, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}}月\\d{{1,2}}日)\\s*', '') AS content FROM documents) SELECT content, count(*) AS n, min(memory_id) AS first_id FROM m GROUP BY content HAVING count(*) >= 3")
def _(s, d):
    # events as documents tell them, some with a date before
    m = v.read(s, d, "documents").select(F.col("doc_id").alias("memory_id"), F.lit("episodic").alias("type"), F.expr(_DATED).alias("content"))
    return memory.reclassify(m)


_PHRASES = ("the estion of", "dans les", "und der heit")


@query(
    "mem_persona_weight",
    f"""WITH {v.MEMORIES}, ph AS (SELECT list_filter(string_split(p, ' '), lambda x: length(x) >= 2)[1:5] AS ws FROM (VALUES {', '.join(f"('{p}')" for p in _PHRASES)}) t(p)),
b AS (SELECT memory_id, any_value(weight) AS weight, any_value(lower(content)) AS c, round(max(len(list_filter(ws, lambda x: contains(lower(content), x))) / len(ws)), 6) AS match FROM memories, ph GROUP BY memory_id)
SELECT memory_id, match, round(CASE WHEN match >= 0.6 THEN least(1.0::DOUBLE, weight + 0.3::DOUBLE) WHEN regexp_matches(c, '\\b(not|no|never)\\b') THEN weight * 0.5 ELSE weight END, 6) AS new_weight FROM b""",
)
def _(s, d):
    return memory.persona_weight(v.memories(s, d), s.createDataFrame([(p,) for p in _PHRASES], "phrase string")).select("memory_id", "match", "new_weight")


@query("mem_recall_feedback", f"WITH {v.MEMORIES}, r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT memory_id, round(CASE WHEN doc_id IS NULL THEN weight ELSE least(1.0::DOUBLE, weight + 0.05::DOUBLE) END, 6) AS new_weight, (access_count + (doc_id IS NOT NULL)::INT)::INT AS new_access FROM memories LEFT JOIN r ON doc_id = memory_id")
def _(s, d):
    r = v.read(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("memory_id"))
    return memory.recall_feedback(v.memories(s, d), r).select("memory_id", "new_weight", "new_access")


_AGE = f"epoch(TIMESTAMP '{NOW}' - created_at) / 86400.0"


@query(
    "mem_age_demote",
    f"""WITH {v.MEMORIES}, f AS (SELECT *, CASE WHEN type IN ('episodic', 'emotional') AND access_count = 0 AND {_AGE} >= 50 AND weight < 0.3 THEN 'archive' WHEN type IN ('episodic', 'emotional') AND {_AGE} >= 45 THEN 'demote' ELSE 'keep' END AS fate FROM memories)
SELECT memory_id, fate, round(CASE fate WHEN 'demote' THEN weight * 0.5 ELSE weight END, 6) AS new_weight FROM f""",
)
def _(s, d):
    return memory.age_and_demote(v.memories(s, d), NOW, idle_days=45, archive_days=50, archive_below=0.3).select("memory_id", "fate", "new_weight")


_BUDGET = 3000


def _pack_sql() -> str:
    parts = ["p0 AS (SELECT *, 0 AS b FROM run WHERE bucket = 0 AND running <= %d), u0 AS (SELECT %d - coalesce(max(running), 0) AS rest FROM p0)" % (_BUDGET, _BUDGET)]
    for i in (1, 2, 3):
        parts.append(f"p{i} AS (SELECT run.*, {i} AS b FROM run, u{i - 1} WHERE bucket = {i} AND running <= rest), u{i} AS (SELECT (SELECT rest FROM u{i - 1}) - coalesce(max(running), 0) AS rest FROM p{i})")
    label = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in memory.LABELS.items())
    return f"""WITH {v.MEMORIES}, l AS (SELECT memory_id, type, CASE type WHEN 'procedural' THEN 0 WHEN 'semantic' THEN 1 WHEN 'episodic' THEN 2 ELSE 3 END AS bucket, weight, length(CASE type {label} END || ' ' || content) // 4 AS tokens FROM memories),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY bucket ORDER BY weight DESC, memory_id) AS running FROM l), {', '.join(parts)}
SELECT memory_id, type, tokens::INT AS tokens, running::BIGINT AS running FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


@query("mem_context_pack", _pack_sql())
def _(s, d):
    return memory.pack(v.memories(s, d), _BUDGET).select("memory_id", "type", "tokens", "running")


@query("mem_type_stats", f"WITH {v.MEMORIES} SELECT type, count(*) AS n, round(avg(weight), 6) AS mean_weight, sum(access_count)::BIGINT AS accesses FROM memories GROUP BY type")
def _(s, d):
    return memory.type_stats(v.memories(s, d))


# ---------------------------------------------------------------- sketches

_TOKENS = "t AS (SELECT msg_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS ts FROM messages)"
_BITS = "unnest(range(128)) AS b"
_PRINTS = f"""{_TOKENS}, u AS (SELECT msg_id, md5(unnest(ts)) AS h FROM t), nib AS (SELECT msg_id, i, ('0x' || substring(h, i, 1))::INT AS x FROM u, range(1, 33) r(i)),
cnt AS (SELECT msg_id, i, count(*) AS n, count(*) FILTER (WHERE x & 8 > 0) AS b3, count(*) FILTER (WHERE x & 4 > 0) AS b2, count(*) FILTER (WHERE x & 2 > 0) AS b1, count(*) FILTER (WHERE x & 1 > 0) AS b0 FROM nib GROUP BY ALL),
prints AS (SELECT msg_id, string_agg(substring('0123456789abcdef', 1 + 8 * (2 * b3 > n)::INT + 4 * (2 * b2 > n)::INT + 2 * (2 * b1 > n)::INT + (2 * b0 > n)::INT, 1), '' ORDER BY i) AS simhash FROM cnt GROUP BY msg_id)"""


@query("simhash_fp", f"WITH {v.MESSAGES}, {_PRINTS} SELECT messages.msg_id, simhash FROM messages LEFT JOIN prints USING (msg_id)")
def _(s, d):
    return sketches.fingerprints(v.messages(s, d)).select("msg_id", "simhash")


_LIMB = " + ".join(f"bit_count(xor(('0x' || substring(simhash, {8 * i + 1}, 8))::BIGINT, ('0x' || substring(query, {8 * i + 1}, 8))::BIGINT))" for i in range(4))


@query(
    "simhash_near",
    f"""WITH {v.MESSAGES.replace("messages AS (", "said AS (", 1)}, messages AS (SELECT msg_id, text FROM said UNION ALL SELECT -1 - item_id, text FROM benchmark), {_PRINTS}, q AS (SELECT -1 - msg_id AS query_id, simhash AS query FROM prints WHERE msg_id < 0),
x AS (SELECT query_id, msg_id, ({_LIMB})::INT AS distance FROM prints, q WHERE msg_id >= 0) SELECT query_id, msg_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, msg_id)::INT AS rank FROM x WHERE distance <= 55 QUALIFY rank <= 10""",
)
def _(s, d):
    asked = sketches.fingerprints(v.questions(s, d).withColumnRenamed("query_id", "msg_id")).select(F.col("msg_id").alias("query_id"), F.col("simhash").alias("query"))
    return sketches.near(sketches.fingerprints(v.messages(s, d)), asked, 55)


_SEED = "unnest(list_transform(range(7), lambda s: (('0x' || substring(sha256(s || ':' || {}), 1, 8))::BIGINT % 1048576)::INT))"


@query("bloom_positions", f"WITH {v.MESSAGES}, w AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS token FROM messages), p AS (SELECT token, {_SEED.format('token')} AS bit FROM w) SELECT bit, count(*) AS items FROM p GROUP BY bit")
def _(s, d):
    w = v.messages(s, d).select(F.explode(text.words(F.col("text"))).alias("token")).distinct()
    return w.select(F.explode(sketches.bloom_positions(F.col("token"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("items"))


@query(
    "bloom_sense",
    f"""WITH {v.MESSAGES}, held AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS token FROM messages WHERE sender = 'agent'), bits AS (SELECT DISTINCT {_SEED.format('token')} AS bit FROM held),
a AS (SELECT DISTINCT msg_id, unnest({_WORDS_SQL}) AS token FROM messages WHERE sender = 'user'), pos AS (SELECT DISTINCT token, {_SEED.format('token')} AS bit FROM (SELECT DISTINCT token FROM a)),
seen AS (SELECT token, bool_and(bit IN (SELECT bit FROM bits)) AS seen FROM pos GROUP BY token)
SELECT msg_id, count(*) AS tokens, count(*) FILTER (WHERE seen) AS known, round(count(*) FILTER (WHERE seen) / count(*), 6) AS familiar FROM a JOIN seen USING (token) GROUP BY msg_id""",
)
def _(s, d):
    m = v.messages(s, d)
    held = m.where("sender = 'agent'").select(F.explode(text.words(F.col("text"))).alias("token")).distinct()
    return sketches.sense(m.where("sender = 'user'"), text.words(F.col("text")), sketches.bloom(held, "token"))


_SIGHT = f"x AS (SELECT msg_id, ts, substring(text, 1, 80) AS snippet, unnest({_WORDS_SQL}) AS token FROM messages), sight AS (SELECT token, min(ts) AS born, max(ts) AS last_seen, count(*) AS sightings, least(count(DISTINCT msg_id), 50) AS traces, arg_min(snippet, msg_id) AS snippet FROM x GROUP BY token)"


def _sightings(s, d):
    return sketches.sightings(v.messages(s, d), text.words(F.col("text")))


@query("phantom_stats", f"WITH {v.MESSAGES}, {_SIGHT} SELECT token, {_STAMP.format('born')} AS born, {_STAMP.format('last_seen')} AS last_seen, sightings, traces, snippet FROM sight")
def _(s, d):
    return _sightings(s, d).select("token", stamp("born").alias("born"), stamp("last_seen").alias("last_seen"), "sightings", "traces", "snippet")


@query("phantom_topk", f"WITH {v.MESSAGES}, {_SIGHT} SELECT token, sightings FROM sight WHERE contains(token, 'tion') ORDER BY sightings DESC, token LIMIT 20")
def _(s, d):
    return _sightings(s, d).where(F.contains("token", F.lit("tion"))).orderBy(F.desc("sightings"), "token").limit(20).select("token", "sightings")


@query("phantom_cleanup", f"WITH {v.MESSAGES}, {_SIGHT} SELECT last_seen >= TIMESTAMP '2024-02-01' AS stays, count(*) AS n FROM sight GROUP BY 1")
def _(s, d):
    return _sightings(s, d).groupBy((F.col("last_seen") >= F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("stays")).agg(F.count("*").alias("n"))


@query(
    "phantom_hunt",
    f"""WITH {v.MESSAGES}, {_SIGHT}, q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'estion'), (1, 'zzzz'), (2, 'und'), (2, 'heit')) t(query_id, token))
SELECT query_id, count(*) AS tokens, count(sightings) AS known, round(0.6 * count(sightings) / count(*) + 0.4 * least(1.0, coalesce(max(sightings), 0) / 20.0), 6)::DOUBLE AS conviction FROM q LEFT JOIN sight USING (token) GROUP BY query_id""",
)
def _(s, d):
    q = s.createDataFrame([(1, "the"), (1, "estion"), (1, "zzzz"), (2, "und"), (2, "heit")], "query_id int, token string")
    j = q.join(_sightings(s, d), "token", "left").groupBy("query_id")
    conviction = 0.6 * F.count("sightings") / F.count("*") + 0.4 * F.least(F.lit(1.0), F.coalesce(F.max("sightings"), F.lit(0)) / 20.0)
    return j.agg(F.count("*").alias("tokens"), F.count("sightings").alias("known"), F.round(conviction, 6).alias("conviction"))


# ---------------------------------------------------------------- behaviour

_LAST = "last{n} AS (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= {n})"
_L50 = _LAST.format(n=50, t="decisions")


@query(
    "drift_comprehensive",
    f"""WITH {v.DECISIONS}, {_L50}, f AS (SELECT *, CASE WHEN direction = lag(direction) OVER w AND direction <> 'neutral' THEN 0 ELSE 1 END AS n FROM last50 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f), g AS (SELECT user_id, run, list_reduce(list(drift::DOUBLE ORDER BY ts, event_id), lambda a, x: trunc(a * 0.7::DOUBLE + x * 0.3::DOUBLE)) AS d, count(*) AS w FROM r GROUP BY ALL),
t AS (SELECT user_id, round_even(sum(d * w) / sum(w), 0)::INT AS drift, count(*) AS runs FROM g GROUP BY 1),
m AS (SELECT user_id, count(*) AS decisions, count(*) FILTER (WHERE direction = 'frugal') AS a, count(*) FILTER (WHERE direction = 'spend') AS b, count(*) FILTER (WHERE direction = 'drift') AS c, count(*) FILTER (WHERE direction = 'neutral') AS e FROM last50 GROUP BY 1)
SELECT user_id, drift, runs, decisions, CASE greatest(a, b, c, e) WHEN a THEN 'frugal' WHEN b THEN 'spend' WHEN c THEN 'drift' ELSE 'neutral' END AS majority FROM t JOIN m USING (user_id)""",
)
def _(s, d):
    return analytics.drift(v.decisions(s, d))


@query("drift_ratio", f"WITH {v.DECISIONS}, {_L50} SELECT user_id, count(*) AS n, " + ", ".join(f"round_even(100.0::DOUBLE * count(*) FILTER (WHERE direction = '{x}') / count(*), 0)::INT AS {x}_pct" for x in ("frugal", "spend", "drift")) + " FROM last50 WHERE direction <> 'neutral' GROUP BY user_id")
def _(s, d):
    return analytics.ratio(v.decisions(s, d))


@query("drift_stability", f"WITH {v.DECISIONS}, g AS (SELECT user_id, scene, count(*) AS n, round(stddev_samp(drift), 4) AS deviation FROM decisions GROUP BY ALL HAVING count(*) >= 2) SELECT *, CASE WHEN deviation < 15 THEN 'steady' WHEN deviation < 30 THEN 'mild' WHEN deviation < 50 THEN 'swinging' ELSE 'wild' END AS band FROM g")
def _(s, d):
    return analytics.stability(v.decisions(s, d), ["user_id", "scene"])


@query(
    "drift_slope",
    f"""WITH {v.DECISIONS}, {_L50}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM last50), g AS (SELECT user_id, count(*) AS n, round(regr_slope(drift, i), 6) AS slope, arg_max(drift, i)::INT AS current FROM i GROUP BY user_id HAVING count(*) >= 10)
SELECT user_id, n, slope, current, CASE WHEN slope <> 0 THEN trunc((CASE WHEN slope > 0 THEN 60 ELSE -60 END - current) / slope)::INT END AS eta, least(70, greatest(10, trunc(100 - 20 * abs(slope))::INT))::INT AS confidence FROM g""",
)
def _(s, d):
    return analytics.slope(v.decisions(s, d))


@query("stage_switch_flag", f"WITH {v.DECISIONS}, {_LAST.format(n=20, t='decisions')} SELECT user_id, direction, count(*) AS strong, count(*) >= 8 AS switches FROM last20 WHERE abs(drift) >= 60 GROUP BY ALL")
def _(s, d):
    return analytics.switch_flag(v.decisions(s, d))


@query("mood_entropy", f"WITH {v.MOODS}, c AS (SELECT user_id, mood, count(*) AS c FROM moods GROUP BY ALL), p AS (SELECT user_id, c, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, sum(c)::BIGINT AS n, round(-sum(p * ln(p)), 4) + 0.0 AS entropy FROM p GROUP BY user_id")
def _(s, d):
    return analytics.entropy(v.moods(s, d), ["user_id"], "mood")


@query("mood_wind", f"WITH {v.MOODS}, {_LAST.format(n=80, t='moods')} SELECT user_id, count(*) AS n, round(avg(valence), 4) AS wind FROM last80 GROUP BY user_id")
def _(s, d):
    return analytics.wind(v.moods(s, d))


_MATRIX = "m AS (SELECT stage, scene, n, first_seen, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY stage), 0)::INT AS share FROM (SELECT stage, scene, count(*) AS n, min(ts) AS first_seen FROM decisions GROUP BY ALL))"


@query("scene_matrix", f"WITH {v.DECISIONS}, {_MATRIX} SELECT stage, scene, n, share, {_STAMP.format('first_seen')} AS first_seen FROM m")
def _(s, d):
    return analytics.scene_matrix(v.decisions(s, d)).select("stage", "scene", "n", "share", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("scene_dominance", f"WITH {v.DECISIONS}, {_MATRIX}, a AS (SELECT scene, share FROM m WHERE stage = (SELECT min(stage) FROM m)), b AS (SELECT scene, share FROM m WHERE stage = (SELECT max(stage) FROM m)) SELECT coalesce(a.scene, b.scene) AS scene, coalesce(a.share, 0)::INT AS from_pct, coalesce(b.share, 0)::INT AS to_pct, (coalesce(b.share, 0) - coalesce(a.share, 0))::INT AS shift FROM a FULL JOIN b ON a.scene = b.scene")
def _(s, d):
    return analytics.scene_shift(v.decisions(s, d))


@query(
    "scene_emerging_fading",
    f"""WITH {v.MESSAGES}, w AS (SELECT ts, unnest({_WORDS_SQL}) AS word FROM messages), r AS (SELECT word, count(*) AS rc FROM w WHERE ts >= TIMESTAMP '2024-02-15' GROUP BY 1), h AS (SELECT word, count(*) AS hc FROM w WHERE ts < TIMESTAMP '2024-02-15' GROUP BY 1),
j AS (SELECT coalesce(r.word, h.word) AS word, coalesce(rc, 0) AS rc, coalesce(hc, 0) AS hc FROM r FULL JOIN h ON r.word = h.word),
k AS (SELECT *, CASE WHEN rc >= 2 AND (hc = 0 OR rc / hc >= 3) THEN 'emerging' WHEN hc >= 3 AND rc = 0 THEN 'fading' END AS kind FROM j) SELECT * FROM k WHERE kind IS NOT NULL""",
)
def _(s, d):
    w = v.messages(s, d).select("ts", F.explode(text.words(F.col("text"))).alias("word"))
    cut = F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    return analytics.emerging(w.where(F.col("ts") >= cut), w.where(F.col("ts") < cut))


@query(
    "stage_similarity",
    f"""WITH {v.DECISIONS}, s AS (SELECT DISTINCT stage, scene FROM decisions), n AS (SELECT stage, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.stage AS stage_a, b.stage AS stage_b, count(*) AS common FROM s a JOIN s b ON a.scene = b.scene AND a.stage < b.stage GROUP BY ALL),
x AS (SELECT stage_a, stage_b, common, round_even(common / greatest(na.n, nb.n), 2)::DOUBLE AS similarity FROM p JOIN n na ON na.stage = stage_a JOIN n nb ON nb.stage = stage_b)
SELECT *, CASE WHEN similarity >= 0.7 THEN 'same' WHEN similarity >= 0.4 THEN 'related' ELSE 'apart' END AS band FROM x""",
)
def _(s, d):
    return analytics.stage_similarity(v.decisions(s, d))


@query(
    "stage_links",
    f"""WITH {v.DECISIONS}, s AS (SELECT stage, count(*) AS n, sum(drift)::BIGINT AS drift, sum(abs(drift))::BIGINT AS turmoil FROM decisions GROUP BY 1), l AS (SELECT *, lead(stage) OVER (ORDER BY stage) AS next_stage, lead(drift) OVER (ORDER BY stage) AS next_drift FROM s)
SELECT *, CASE WHEN next_drift > drift THEN 'up' WHEN next_drift < drift THEN 'down' ELSE 'flat' END AS trend FROM l WHERE next_stage IS NOT NULL""",
)
def _(s, d):
    return analytics.stage_links(v.decisions(s, d))


@query(
    "contradiction_rules",
    f"""WITH {v.DECISIONS}, {_L50}, {_LAST.format(n=20, t='decisions')}, p AS (SELECT user_id, count(*) FILTER (WHERE direction = 'frugal') AS f, count(*) FILTER (WHERE direction = 'spend') AS s, avg(drift) AS d, stddev_samp(drift) AS v FROM decisions GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM last50), foretold AS (SELECT user_id FROM i GROUP BY 1 HAVING count(*) >= 10 AND abs(round(regr_slope(drift, i), 6)) >= 0.1),
switched AS (SELECT user_id FROM last20 WHERE abs(drift) >= 60 GROUP BY user_id, direction HAVING count(*) >= 8),
sn AS (SELECT user_id, stage, scene, count(*) AS n FROM decisions GROUP BY ALL), sc AS (SELECT *, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY user_id, stage), 0)::INT AS share FROM sn),
ends AS (SELECT *, min(stage) OVER w AS a, max(stage) OVER w AS b FROM sc WINDOW w AS (PARTITION BY user_id)),
moved AS (SELECT user_id, scene FROM ends WHERE a < b GROUP BY user_id, scene HAVING abs(coalesce(max(share) FILTER (WHERE stage = b), 0) - coalesce(max(share) FILTER (WHERE stage = a), 0)) >= 30)
SELECT user_id, 'frugal_words_spending_drift' AS rule FROM p WHERE f > s AND d <= -30 UNION ALL SELECT user_id, 'spending_words_frugal_drift' FROM p WHERE s > f AND d >= 30
UNION ALL SELECT user_id, 'volatile' FROM p WHERE v >= 40 AND user_id NOT IN (SELECT user_id FROM foretold)
UNION ALL SELECT DISTINCT user_id, 'scene_moved_without_switch' FROM moved WHERE user_id NOT IN (SELECT user_id FROM switched)""",
)
def _(s, d):
    return analytics.contradictions(v.decisions(s, d))


@query(
    "persona_local",
    f"""WITH {v.MESSAGES}, h AS (SELECT 'after_the' AS category, lower(trim(unnest(regexp_extract_all(text, 'the ([a-z]+)', 1)))) AS hit FROM messages UNION ALL SELECT 'after_les', lower(trim(unnest(regexp_extract_all(text, 'les ([a-z]+)', 1)))) FROM messages),
g AS (SELECT category, hit, count(*) AS n FROM h WHERE length(hit) BETWEEN 2 AND 30 GROUP BY ALL HAVING count(*) >= 2) SELECT category, hit, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, hit)::INT AS rank FROM g QUALIFY rank <= 5""",
)
def _(s, d):
    return analytics.persona(v.messages(s, d), {"after_the": "the ([a-z]+)", "after_les": "les ([a-z]+)"})


_HASH = "substring(sha256(left(text, 300)), 1, 8)"


@query("provenance_verify", f"WITH {v.CORPUS}, c AS (SELECT doc_id AS msg_id, substring(sha256(left(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END, 300)), 1, 8) AS claimed FROM documents) SELECT CASE WHEN corpus.text IS NULL THEN 'missing' WHEN {_HASH} = claimed THEN 'ok' ELSE 'mismatch' END AS state, count(*) AS n FROM c LEFT JOIN corpus USING (msg_id) GROUP BY 1")
def _(s, d):
    c = v.corpus(s, d)
    claims = c.select("msg_id", text.line_hash(F.when(F.col("msg_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("claimed"))
    state = F.when(F.col("text").isNull(), "missing").when(text.line_hash(F.col("text")) == F.col("claimed"), "ok").otherwise("mismatch")
    return claims.join(c, "msg_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("persona_diff", f"WITH {v.CORPUS}, o AS (SELECT DISTINCT {_HASH} AS hash FROM corpus WHERE lang IN ('en', 'fr')), n AS (SELECT DISTINCT {_HASH} AS hash FROM corpus WHERE lang IN ('fr', 'de')) SELECT coalesce(o.hash, n.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'unchanged' END AS state FROM o FULL JOIN n ON o.hash = n.hash")
def _(s, d):
    c = v.corpus(s, d).select("lang", text.line_hash(F.col("text")).alias("hash"))
    return analytics.set_diff(c.where("lang in ('en', 'fr')"), c.where("lang in ('fr', 'de')"), "hash")


@query(
    "user_sessions",
    """WITH f AS (SELECT *, CASE WHEN epoch(ts - lag(ts) OVER w) <= 7200 THEN 0 ELSE 1 END AS n FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM f)
SELECT user_id, session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY ALL""",
)
def _(s, d):
    e = v.read(s, d, "events").select("event_id", "user_id", F.expr("cast(date_trunc('second', ts) as timestamp_ntz)").alias("ts"))
    return analytics.sessions(e, "user_id", 120).select("user_id", "session", "events", stamp("started").alias("started"), stamp("ended").alias("ended"))


@query("tumbling_entropy", f"WITH {v.MOODS}, c AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w, mood, count(*) AS c FROM moods GROUP BY ALL), p AS (SELECT w, c, c / sum(c) OVER (PARTITION BY w) AS p FROM c) SELECT {_STAMP.format('w')} AS opened, sum(c)::BIGINT AS n, round(-sum(p * ln(p)), 4) + 0.0 AS entropy FROM p GROUP BY w")
def _(s, d):
    m = v.moods(s, d).select(F.window("ts", "6 hours")["start"].alias("opened"), "mood")
    return analytics.entropy(m, ["opened"], "mood").select(F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n", "entropy")


@query("tag_weights_top20", f"WITH {v.DECISIONS} SELECT scene || ':' || direction AS tag, count(*) AS n FROM decisions GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def _(s, d):
    return v.decisions(s, d).groupBy(F.concat("scene", F.lit(":"), "direction").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("rollup_stage_scene", f"WITH {v.DECISIONS} SELECT coalesce(stage::VARCHAR, 'all') AS stage, coalesce(scene, 'all') AS scene, count(*) AS n, sum(drift)::BIGINT AS drift FROM decisions GROUP BY ROLLUP (decisions.stage, decisions.scene)")
def _(s, d):
    r = v.decisions(s, d).rollup("stage", "scene").agg(F.count("*").alias("n"), F.sum("drift").alias("drift"))
    return r.select(F.coalesce(F.col("stage").cast("string"), F.lit("all")).alias("stage"), F.coalesce("scene", F.lit("all")).alias("scene"), "n", "drift")


_TASK = "SELECT o_orderkey AS seq, 'order ' || o_orderkey AS task, o_orderpriority AS trigger, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'done' END AS status FROM orders"


@query("task_triggers", f"WITH t AS ({_TASK}) SELECT substring(md5(task || trigger), 1, 8) AS id, task FROM t WHERE status = 'pending' AND contains(lower(trigger), 'urgent')")
def _(s, d):
    pending = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done")
    t = v.read(s, d, "orders").select(F.concat(F.lit("order "), "o_orderkey").alias("task"), F.col("o_orderpriority").alias("trigger"), pending.alias("status"))
    return t.where((F.col("status") == "pending") & F.contains(F.lower("trigger"), F.lit("urgent"))).select(F.substring(F.md5(F.concat("task", "trigger")), 1, 8).alias("id"), "task")
