"""Registered queries of the memory engine, each with the DuckDB text it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blockmax, log, retrieval, vectors
from ..operators.blocks import against
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: English stand-ins for the lexicons, of words that occur in the tables.
TYPE_WORDS = {"procedural": r"\b(ist|est)\b", "emotional": r"\b(und|pour)\b", "episodic": r"\b(was|with)\b"}
INFO_WORDS = "for|pour|und"
MOOD_WORDS = {"calm": ["of the", "der", "la "], "keen": ["with", "que", "einer"], "glad": ["that", "avec", "und"]}
MOOD_ORDER = ("calm", "keen", "glad")
DRIFT_WORDS = {"frugal": ["this", "est"], "spend": ["from", "dans"], "give_up": ["stupid"], "compromise": ["License"], "annoyed": ["password"]}
DIRECTION_WORDS = {"frugal": ["stupid"], "spend": ["license"], "drift": ["token"]}
NOW = "2024-03-01"
#: The stated query set of the searches that look at every text: every 20th item of the benchmark.
ASKED = "item_id % 20 = 0"

_WORDS_SQL = "regexp_extract_all(lower(text), '[a-zA-Z0-9_]{2,}')"
_ASKED_SQL = f"asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE {ASKED})"
_LONGEST_SQL = f"SELECT query_id, max_by(word, lpad(length(word)::VARCHAR, 6, '0') || word) AS word FROM (SELECT query_id, unnest({_WORDS_SQL}) AS word FROM asked) GROUP BY query_id"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read(spark, sf_dir, "benchmark").where(ASKED).select(F.col("item_id").alias("query_id"), "text")


def longest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, word): the longest word of each stated query, the last one of equal length."""
    ws = asked(spark, sf_dir).select("query_id", F.explode(text.words(F.col("text"))).alias("word"))
    return ws.groupBy("query_id").agg(F.max(F.struct(F.length("word"), "word"))["word"].alias("word"))


def stamp(c: str):
    return F.col(c).cast("string")


# ---------------------------------------------------------------- log


@query("log_recent", f"WITH {v.MESSAGES} SELECT msg_id, sender, text FROM messages ORDER BY msg_id DESC LIMIT 25")
def _(s, d):
    return log.recent(v.messages(s, d), 25).select("msg_id", "sender", "text")


@query("log_substring_scan", f"WITH {v.MESSAGES} SELECT msg_id, sender, text FROM messages WHERE contains(lower(text), 'tion of')")
def _(s, d):
    return log.substring_scan(v.messages(s, d), "tion OF").select("msg_id", "sender", "text")


@query(
    "log_value_filter",
    f"""WITH {v.MESSAGES}, x AS (SELECT msg_id, sender, least(3 + 2 * (length(text) > 50)::INT + 2 * regexp_matches(text, '\\d')::INT + regexp_matches(text, '[.:;]')::INT * 0 + 2 * regexp_matches(text, '{INFO_WORDS}')::INT, 10) / 10 AS info_value FROM messages)
SELECT msg_id, sender, info_value::DOUBLE AS info_value FROM x WHERE sender <> 'agent' OR info_value >= 0.3""",
)
def _(s, d):
    m = v.messages(s, d).withColumn("info_value", text.info_value(F.col("text"), INFO_WORDS))
    return m.where("sender <> 'agent' or info_value >= 0.3").select("msg_id", "sender", "info_value")


_FATE = f"""fates AS (SELECT *, strftime(ts, '%Y-%m') AS month, CASE WHEN date_diff('day', ts::DATE, DATE '{NOW}') <= 30 THEN 'kept'
  WHEN sender = 'agent' AND length(text) < 100 AND NOT regexp_matches(text, '\\d{{3,}}') THEN 'dropped' ELSE 'moved' END AS fate FROM messages)"""


@query("log_archive_split", f"WITH {v.MESSAGES}, {_FATE} SELECT month, fate, count(*) AS n FROM fates GROUP BY ALL")
def _(s, d):
    return log.fate(v.messages(s, d), NOW, keep_pattern=r"\d{3,}").groupBy("month", "fate").agg(F.count("*").alias("n"))


@query("log_archive_stats", f"WITH {v.MESSAGES} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(length(text))::BIGINT AS chars FROM messages GROUP BY 1")
def _(s, d):
    return log.archive_stats(v.messages(s, d))


@query(
    "import_dedup",
    f"""WITH {v.MESSAGES}, incoming AS (SELECT ts, sender, text FROM messages UNION ALL SELECT ts + to_minutes(1), sender, text FROM messages)
SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT ts, sender, text FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.ts = i.ts AND m.sender = i.sender AND m.text = i.text))""",
)
def _(s, d):
    m = v.messages(s, d).select("ts", "sender", "text")
    incoming = m.unionAll(m.withColumn("ts", F.expr("ts + interval 1 minute")))
    return log.merge_new(m, incoming, ["ts", "sender", "text"]).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("role_counts", f"WITH {v.MESSAGES} SELECT sender, count(*) AS n, sum(length(text))::BIGINT AS chars FROM messages GROUP BY sender")
def _(s, d):
    return log.role_counts(v.messages(s, d))


@query("timeline_by_period", f"WITH {v.MESSAGES} SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n, arg_min(text, msg_id) AS first_text, arg_max(text, msg_id) AS last_text FROM messages GROUP BY 1")
def _(s, d):
    return log.timeline(v.messages(s, d), F.date_format("ts", "yyyy-MM"))


@query("message_buffer", f"WITH {v.MESSAGES} SELECT conv_id, msg_id, sender FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY msg_id DESC) <= 5")
def _(s, d):
    return log.buffer(v.messages(s, d), "conv_id").select("conv_id", "msg_id", "sender")


@query("scene_timeline_dedup", f"WITH {v.DECISIONS} SELECT event_id, user_id, scene FROM decisions QUALIFY lag(scene) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM scene")
def _(s, d):
    return log.consecutive_distinct(v.decisions(s, d), "user_id", ["ts", "event_id"], "scene").select("event_id", "user_id", "scene")


# ---------------------------------------------------------------- text


@query("tok_words", f"WITH {v.MESSAGES}, t AS (SELECT msg_id, {_WORDS_SQL} AS w FROM messages) SELECT msg_id, len(w)::INT AS n, array_to_string(w, ' ') AS tokens FROM t")
def _(s, d):
    return v.messages(s, d).select("msg_id", text.words(F.col("text")).alias("w")).select("msg_id", F.size("w").alias("n"), F.array_join("w", " ").alias("tokens"))


@query("tok_fts_bag", f"WITH {v.CORPUS}, t AS (SELECT msg_id, list_sort(list_distinct({_WORDS_SQL})) AS w FROM corpus) SELECT msg_id, len(w)::INT AS n, array_to_string(w, ' ') AS tokens FROM t")
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.fts_tokens(F.col("text")).alias("w")).select("msg_id", F.size("w").alias("n"), F.array_join("w", " ").alias("tokens"))


@query(
    "tok_char_windows",
    f"""WITH {v.MESSAGES}, c AS (SELECT msg_id, {_WORDS_SQL} AS w, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM messages),
g AS (SELECT msg_id, list_distinct(list_concat(w, list_transform(range(1, length(s)), lambda i: s[i:i+1]), list_transform(range(1, length(s) - 1), lambda i: s[i:i+2]), list_transform(range(1, length(s) - 2), lambda i: s[i:i+3]))) AS t FROM c)
SELECT msg_id, len(t)::INT AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM g""",
)
def _(s, d):
    return v.messages(s, d).select("msg_id", text.index_tokens(F.col("text")).alias("t")).select("msg_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("tok_lang_detect", f"WITH {v.CORPUS} SELECT msg_id, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 'mixed' ELSE 'zh' END ELSE 'en' END AS language FROM corpus")
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.language(F.col("text")).alias("language"))


@query(
    "tok_entities",
    f"""WITH {v.CORPUS}, e AS (SELECT msg_id, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '[A-Z][a-z]+(?:[ \\t\\n\\x0B\\f\\r]+[A-Z][a-z]+)+'), regexp_extract_all(text, '"[^"]+"'), regexp_extract_all(text, '''[^'']+'''), list_filter(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_.\\-]{{2,}}'), lambda x: length(x) <= 40)), lambda x: lower(x)))) AS t FROM corpus)
SELECT msg_id, len(t)::INT AS n, md5(array_to_string(t, '|')) AS digest FROM e""",
)
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.entities(F.col("text")).alias("t")).select("msg_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("digest"))


@query("classify_memory_type", f"WITH {v.MESSAGES} SELECT msg_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in TYPE_WORDS.items()) + " ELSE 'semantic' END AS type FROM messages")
def _(s, d):
    return v.messages(s, d).select("msg_id", text.memory_type(F.col("text"), TYPE_WORDS).alias("type"))


_MOOD_CASE = " ".join(f"WHEN contains(lower(text), '{w}') THEN '{m}'" for m in MOOD_ORDER for w in sorted(MOOD_WORDS[m], key=len, reverse=True))


@query("mood_detect", f"WITH {v.CORPUS} SELECT msg_id, CASE {_MOOD_CASE} ELSE '' END AS mood FROM corpus")
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.mood(F.col("text"), MOOD_WORDS, MOOD_ORDER).alias("mood"))


def _any(ws):
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in ws) + ")"


def _count(ws):
    return "(" + " + ".join(f"contains(text, '{w}')::INT" for w in ws) + ")"


@query(
    "drift_score",
    f"""WITH {v.CORPUS} SELECT msg_id, (CASE WHEN {_any(DRIFT_WORDS['give_up'])} THEN -100 WHEN {_any(DRIFT_WORDS['compromise'])} THEN -60 WHEN {_any(DRIFT_WORDS['annoyed'])} THEN -30
  WHEN {_count(DRIFT_WORDS['spend'])} > {_count(DRIFT_WORDS['frugal'])} THEN -20 * ({_count(DRIFT_WORDS['spend'])} - {_count(DRIFT_WORDS['frugal'])}) WHEN {_count(DRIFT_WORDS['frugal'])} > 0 THEN 15 * {_count(DRIFT_WORDS['frugal'])} ELSE 0 END)::INT AS score FROM corpus""",
)
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.drift_score(F.col("text"), DRIFT_WORDS).alias("score"))


@query(
    "choice_direction",
    "WITH " + v.CORPUS + ", l AS (SELECT msg_id, lower(text) AS text FROM corpus) SELECT msg_id, CASE " + " ".join(f"WHEN {_any(ws)} THEN '{k}'" for k, ws in DIRECTION_WORDS.items()) + " ELSE 'neutral' END AS direction FROM l",
)
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.direction(F.col("text"), DIRECTION_WORDS).alias("direction"))


@query(
    "decision_options",
    f"""WITH {v.MESSAGES} SELECT msg_id, array_to_string(list_filter(list_transform(string_split(text, ' or ')[1:5], lambda x: left(trim(x), 20)), lambda x: x <> ''), '_') AS options FROM messages""",
)
def _(s, d):
    return v.messages(s, d).select("msg_id", text.options(F.col("text")).alias("options"))


@query("token_estimate", f"WITH {v.CORPUS} SELECT msg_id, (length(text) // 4)::INT AS tokens, 'semantic-' || substring(sha1('semantic:' || text), 1, 16) AS memory_id FROM corpus")
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.memory_id(F.col("text"), F.lit("semantic")).alias("memory_id"))


@query(
    "synonym_expand",
    f"""WITH {v.QUESTIONS}, t AS (SELECT DISTINCT query_id, unnest({_WORDS_SQL}) AS token FROM questions), syn AS (SELECT * FROM (VALUES ('the', 'that'), ('the', 'this'), ('of', 'from'), ('und', 'mit'), ('les', 'des'), ('that', 'which')) s(word, other))
SELECT query_id, token AS term, 0 AS hop FROM t UNION SELECT query_id, other, 1 FROM t JOIN syn ON token = word WHERE (query_id, other) NOT IN (SELECT query_id, token FROM t)""",
)
def _(s, d):
    t = retrieval.query_tokens(v.questions(s, d), text.words(F.col("text")))
    syn = s.createDataFrame([("the", "that"), ("the", "this"), ("of", "from"), ("und", "mit"), ("les", "des"), ("that", "which")], "token string, other string")
    more = t.join(F.broadcast(syn), "token").select("query_id", F.col("other").alias("token")).distinct().join(t, ["query_id", "token"], "left_anti")
    return t.select("query_id", F.col("token").alias("term"), F.lit(0).alias("hop")).unionAll(more.select("query_id", "token", F.lit(1)))


# ---------------------------------------------------------------- retrieval

_POSTINGS = f"postings AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS token, msg_id FROM corpus)"
_QTOKENS = f"qtokens AS (SELECT DISTINCT query_id, unnest({_WORDS_SQL}) AS token FROM questions)"
_ATOKENS = f"qtokens AS (SELECT DISTINCT query_id, unnest({_WORDS_SQL}) AS token FROM asked)"
_BASE = f"{v.CORPUS}, {v.QUESTIONS}, {_POSTINGS}, {_QTOKENS}"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, msg_id)::INT AS rank"


def _qt(s, d):
    return retrieval.query_tokens(v.questions(s, d), text.words(F.col("text")))


def _at(s, d):
    return retrieval.query_tokens(asked(s, d), text.words(F.col("text")))


@query("postings_build", f"WITH {v.CORPUS}, {_POSTINGS} SELECT token, count(*) AS df, min(msg_id) AS first_id, max(msg_id) AS last_id FROM postings GROUP BY token")
def _(s, d):
    return retrieval.posting_lists(v.stored(s, d).snapshot().extents())


@query("postings_topk", f"WITH {_BASE}, h AS (SELECT query_id, msg_id, count(*) AS hits FROM postings JOIN qtokens USING (token) GROUP BY ALL) SELECT query_id, msg_id, hits, {_RANK.format('hits')} FROM h QUALIFY rank <= 10")
def _(s, d):
    return blockmax.count_match(v.stored(s, d), _qt(s, d))


@query("fts_and", f"WITH {_BASE} SELECT query_id, msg_id, count(*) AS hits FROM postings JOIN qtokens USING (token) GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM qtokens q WHERE q.query_id = qtokens.query_id)".replace("(SELECT count(*) FROM qtokens q WHERE q.query_id = qtokens.query_id)", "any_value((SELECT count(*) FROM qtokens q WHERE q.query_id = qtokens.query_id))"))
def _(s, d):
    return blockmax.match_all(v.stored(s, d), _qt(s, d))


_BM25 = f"""st AS (SELECT msg_id, count(*) AS dl FROM postings GROUP BY 1), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM st),
idf AS (SELECT token, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM postings, tot GROUP BY token, n),
bm AS (SELECT query_id, msg_id, round(sum(idf * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM postings JOIN qtokens USING (token) JOIN idf USING (token) JOIN st USING (msg_id), tot GROUP BY ALL)"""


@query("bm25_topk", f"WITH {_BASE}, {_BM25} SELECT query_id, msg_id, score, {_RANK.format('score')} FROM bm QUALIFY rank <= 10")
def _(s, d):
    return blockmax.bm25(v.stored(s, d), _qt(s, d)).drop("hits")


_COSINE = """nn AS (SELECT count(DISTINCT msg_id) AS n FROM postings), idfc AS (SELECT token, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM postings, nn GROUP BY token, n),
dn AS (SELECT msg_id, sqrt(sum(w * w)) AS dn FROM postings JOIN idfc USING (token) GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qtokens JOIN idfc USING (token) GROUP BY 1),
dot AS (SELECT query_id, msg_id, sum(w * w) AS dot FROM postings JOIN idfc USING (token) JOIN qtokens USING (token) GROUP BY ALL), c AS (SELECT query_id, msg_id, round(dot / (dn * qn), 3) AS score FROM dot JOIN dn USING (msg_id) JOIN qn USING (query_id))"""
_TFIDF = """hits AS (SELECT query_id, token, msg_id, (length(lower(text)) - length(replace(lower(text), token, ''))) / length(token) / length(lower(text)) AS tf FROM corpus, qtokens WHERE contains(lower(text), token)),
nn AS (SELECT count(*) AS n FROM corpus), df AS (SELECT query_id, token, ln((n + 1) / (count(*) + 1)) AS idf FROM hits, nn GROUP BY query_id, token, n),
tf AS (SELECT query_id, msg_id, round(sum(tf * idf), 8) AS score FROM hits JOIN df USING (query_id, token) GROUP BY ALL)"""


@query("tfidf_topk", f"WITH {v.CORPUS}, {_ASKED_SQL}, {_ATOKENS}, {_TFIDF} SELECT query_id, msg_id, score, {_RANK.format('score')} FROM tf WHERE score > 0 QUALIFY rank <= 10")
def _(s, d):
    return retrieval.tfidf_substring(v.corpus(s, d), _at(s, d))


@query(
    "tfidf_cosine",
    f"""WITH {_BASE}, {_COSINE}
SELECT query_id, msg_id, score, {_RANK.format('score')} FROM c WHERE score > 0.05 QUALIFY rank <= 10""",
)
def _(s, d):
    return blockmax.tfidf_cosine(v.stored(s, d), _qt(s, d)).drop("hits")


_TRUST = "trust AS (SELECT msg_id, list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN helpful THEN 0.05::DOUBLE ELSE -0.10::DOUBLE END ORDER BY seq)), lambda t, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, t + x))) AS trust, count(*) FILTER (WHERE helpful) AS helpful, count(*) FILTER (WHERE NOT helpful) AS unhelpful FROM feedback GROUP BY msg_id)"


@query("trust_fold", f"WITH {v.FEEDBACK}, {_TRUST} SELECT msg_id, round(trust, 6) AS trust, helpful, unhelpful FROM trust")
def _(s, d):
    return retrieval.trust_fold(v.feedback(s, d)).withColumn("trust", F.round("trust", 6))


@query("trust_boost", f"WITH {v.CORPUS}, {v.FEEDBACK}, {_TRUST} SELECT msg_id, round(coalesce(trust, 0.5), 6) AS trust FROM corpus LEFT JOIN trust USING (msg_id)")
def _(s, d):
    return v.corpus(s, d).select("msg_id").join(retrieval.trust_fold(v.feedback(s, d)), "msg_id", "left").select("msg_id", F.round(F.coalesce("trust", F.lit(0.5)), 6).alias("trust"))


@query(
    "density_rank",
    f"""WITH {v.CORPUS}, {v.FEEDBACK}, {_TRUST}, q AS (SELECT list_distinct({_WORDS_SQL}) AS qt FROM (SELECT 'the estion of inthing and that' AS text)),
x AS (SELECT msg_id, len(list_intersect(list_distinct({_WORDS_SQL}), qt)) / len(qt) AS density FROM corpus, q)
SELECT msg_id, round(density, 6) AS density, round(density * coalesce(trust, 0.5), 6) AS score FROM x LEFT JOIN trust USING (msg_id) WHERE density > 0""",
)
def _(s, d):
    out = retrieval.density(v.corpus(s, d), "the estion of inthing and that", retrieval.trust_fold(v.feedback(s, d)), lambda c: F.array_distinct(text.words(c)))
    return out.where("density > 0").select("msg_id", F.round("density", 6).alias("density"), F.round("score", 6).alias("score"))


_COUNT = f"cm AS (SELECT query_id, msg_id, hits, {_RANK.format('hits')} FROM (SELECT query_id, msg_id, count(*) AS hits FROM postings JOIN qtokens USING (token) GROUP BY ALL) QUALIFY rank <= 10)"
_BMTOP = f"bt AS (SELECT query_id, msg_id, score, {_RANK.format('score')} FROM bm QUALIFY rank <= 10)"


@query("rrf_fuse", f"WITH {_BASE}, {_BM25}, {_COUNT}, {_BMTOP}, l AS (SELECT query_id, msg_id, rank FROM cm UNION ALL SELECT query_id, msg_id, rank FROM bt) SELECT query_id, msg_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM l GROUP BY ALL")
def _(s, d):
    index, qt = v.stored(s, d), _qt(s, d)
    held = index.snapshot()
    lists = blockmax.search(held, qt, [blockmax.by_count(), blockmax.by_bm25(held)], 10).select("query_id", F.col("way").alias("list_id"), "msg_id", "rank")
    return retrieval.rrf(lists).select("query_id", "msg_id", F.round("score", 8).alias("score"))


def _routed(index, qt):
    held = index.snapshot()
    ways = [blockmax.by_count(every=True), blockmax.by_bm25(held), blockmax.by_count(), blockmax.by_cosine(held)]
    return retrieval.route(blockmax.search(held, qt, ways, 10).select("query_id", "msg_id", F.col("way").alias("route"), "rank", "hits"))


_ALL = "al AS (SELECT query_id, msg_id, row_number() OVER (PARTITION BY query_id ORDER BY msg_id)::INT AS rank FROM hit JOIN nq USING (query_id) WHERE c = nq QUALIFY rank <= 10)"
_ROUTED = "routed AS (SELECT query_id, msg_id, route, rank FROM (SELECT query_id, msg_id, 0 AS route, rank FROM al UNION ALL SELECT query_id, msg_id, 1, rank FROM bt UNION ALL SELECT query_id, msg_id, 2, rank FROM cm UNION ALL SELECT query_id, msg_id, 3, rank FROM ct) QUALIFY row_number() OVER (PARTITION BY query_id, msg_id ORDER BY route, rank) = 1)"


@query(
    "router_topk",
    f"""WITH {_BASE}, {_BM25}, {_COUNT}, {_BMTOP}, {_COSINE}, ct AS (SELECT query_id, msg_id, {_RANK.format('score')} FROM c WHERE score > 0.05 QUALIFY rank <= 10), nq AS (SELECT query_id, count(*) AS nq FROM qtokens GROUP BY 1),
hit AS (SELECT query_id, msg_id, count(*) AS c FROM postings JOIN qtokens USING (token) GROUP BY ALL), {_ALL}, {_ROUTED}, {v.FEEDBACK}, {_TRUST},
sc AS (SELECT r.query_id, r.msg_id, route, r.rank AS route_rank, round(c / nq * coalesce(trust, 0.5) + 0.5, 6) AS score FROM routed r JOIN hit USING (query_id, msg_id) JOIN nq USING (query_id) LEFT JOIN trust USING (msg_id))
SELECT query_id, msg_id, route, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, route, route_rank, msg_id)::INT AS rank FROM sc QUALIFY rank <= 10""",
)
def _(s, d):
    qt = _qt(s, d)
    nq = qt.groupBy("query_id").agg(F.count("*").alias("nq"))
    got = _routed(v.stored(s, d), qt).join(nq, "query_id").join(retrieval.trust_fold(v.feedback(s, d)).select("msg_id", "trust"), "msg_id", "left")
    score = F.round(F.col("hits") / F.col("nq") * F.coalesce("trust", F.lit(0.5)) + 0.5, 6)
    scored = got.select("query_id", "msg_id", "route", F.col("rank").alias("route_rank"), score.alias("score"))
    return retrieval.top(scored, "query_id", [F.desc("score"), "route", "route_rank", "msg_id"], 10).drop("route_rank")


@query(
    "minmax_rerank",
    f"WITH {_BASE}, {_BM25}, {_BMTOP} SELECT query_id, msg_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS scaled FROM bt WINDOW w AS (PARTITION BY query_id)",
)
def _(s, d):
    b = blockmax.bm25(v.stored(s, d), _qt(s, d))
    return b.select("query_id", "msg_id", F.round(retrieval.minmax(b, "query_id", "score"), 6).alias("scaled"))


_POS, _NEG = ["that", "avec", "und"], ["was", "pas", "nicht"]


def _hits(ws):
    return "(" + " + ".join(f"contains(text, '{w}')::INT" for w in ws) + ")"


@query(
    "sentiment_rerank",
    f"""WITH {v.CORPUS}, x AS (SELECT msg_id, ({_hits(_POS)} - {_hits(_NEG)}) / greatest(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')), 1) AS s FROM corpus)
SELECT msg_id, round(CASE WHEN s > 0 THEN -s * 0.6 * 0.2 WHEN s < 0 THEN s * 0.6 * 0.1 ELSE 0.6 * 0.15 END, 8)::DOUBLE AS boost FROM x""",
)
def _(s, d):
    return v.corpus(s, d).select("msg_id", F.round(retrieval.sentiment_boost(F.col("text"), -0.6, _POS, _NEG), 8).alias("boost"))


_VQ = "vq AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[])"


def _vq(s, d):
    """A stated query set: the first vector of each label."""
    e = v.read(s, d, "embeddings")
    return e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))


@query("vector_topk", f"WITH {_VQ}, c AS (SELECT query_id, vec_id, round({_COS}, 6) AS score FROM embeddings, vq) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM c QUALIFY rank <= 10")
def _(s, d):
    return vectors.exact_top(v.read(s, d, "embeddings"), _vq(s, d))


@query(
    "vector_promote",
    f"""WITH {_BASE}, {_BM25}, {_BMTOP}, {_VQ}, vs AS (SELECT vec_id AS msg_id, max(round({_COS}, 6)) AS vector_score FROM embeddings, vq GROUP BY 1 HAVING max(round({_COS}, 6)) > 0.3),
j AS (SELECT query_id, msg_id, rank, coalesce(vector_score, 0) AS vector_score FROM bt LEFT JOIN vs USING (msg_id))
SELECT query_id, msg_id, vector_score, row_number() OVER (PARTITION BY query_id ORDER BY (vector_score > 0) DESC, vector_score DESC, rank)::INT AS new_rank FROM j""",
)
def _(s, d):
    b = blockmax.bm25(v.stored(s, d), _qt(s, d))
    e = against(v.read(s, d, "embeddings"), _vq(s, d)).select(F.col("vec_id").alias("msg_id"), F.round(retrieval.cosine(F.col("embedding"), F.col("query")), 6).alias("vector_score")).where("vector_score > 0.3")
    return retrieval.promote(b, e).select("query_id", "msg_id", "vector_score", "new_rank")



@query(
    "eval_recall_at_k",
    f"""WITH {_BASE}, {_COUNT}, ex AS (SELECT query_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS category, (SELECT min(msg_id) FROM corpus c WHERE contains(c.text, q.text)) AS msg_id FROM questions q)
SELECT category, count(*) AS queries, count(*) FILTER (WHERE (query_id, msg_id) IN (SELECT query_id, msg_id FROM cm)) AS hits, round(count(*) FILTER (WHERE (query_id, msg_id) IN (SELECT query_id, msg_id FROM cm)) / count(*), 4) AS recall
FROM ex WHERE msg_id IS NOT NULL GROUP BY category""",
)
def _(s, d):
    q, c = v.questions(s, d), v.corpus(s, d)
    # the passages are a small stated set; each is searched in every text
    found = against(c.select("msg_id", F.col("text").alias("_t")), q).where(F.contains("_t", "text"))
    expected = found.groupBy("query_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("category")).agg(F.min("msg_id").alias("msg_id"))
    return retrieval.recall_at_k(blockmax.count_match(v.stored(s, d), _qt(s, d)), expected)
