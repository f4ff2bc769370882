"""Registered queries of rules whose words don't occur in the tables: over all messages and a few stated ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import graph, memory, state
from ..sources import readers
from ..streaming.ingest import decorate
from . import views as v
from .catalog import _WORDS_SQL, _any, _count

QUERIES: dict = {}
SQL: dict[str, str] = {}

SAID = (
    "我决定用 Rust 写引擎",
    "还是用Python吧, 或者放弃Java了",
    "好的",
    "let's use spark then, never mind",
    "I'll go with plan b, whatever",
    "今天真开心, 跑通了",
    "我不开心, 太难了",
    "烦死了, 不管了",
    "怎么部署这个服务",
    "把 mysql 换成 postgres 了",
    "小王的邮箱是wang@example.com",
    "我住在上海",
    "Spark优于Flink, 我喜欢 Spark",
    "订阅了付费版, 买了两年",
    "开源的免费方案性价比高",
    "没想到竟然 works, amazing",
)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def said(s, d) -> DataFrame:
    """(msg_id, sender, text): all messages, and the stated ones with negative ids."""
    own = s.createDataFrame([(-i - 1, "user", t) for i, t in enumerate(SAID)], "msg_id long, sender string, text string")
    return v.messages(s, d).select("msg_id", "sender", "text").unionAll(own)


_SAID = f"{v.MESSAGES}, said AS (SELECT msg_id, sender, text FROM messages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i - 1}, {_q("user")}, {_q(t)})' for i, t in enumerate(SAID))}) o(msg_id, sender, text))"

_NOISE = r"(?i)^(推|OK|好的|确认|删|发|等|继续|下一个)[吧了]?$|^(还有|还有吗|有没有|在吗|好了吗)[？?]?$|^[a-zA-Z]{1,3}$"
_SIGNAL = r"(?i)(?:还是|或者|or|either).{2,30}|(?:选|用|装|换|搞|跑|试|买|做)|(?:决定|定了|确定)\s*.{1,20}|(?:go with|choose|pick|decide|switch to|use)\s+.{1,30}|(?:不管了|放弃|算了|随便|就那样|能用就行)|(?:give up|whatever|never mind|fine|let's just)"
_DECISION = f"(NOT regexp_matches(trim(text), {_q(_NOISE)}) AND regexp_matches(text, {_q(_SIGNAL)}))"


@query("said_decisions", f"WITH {_SAID} SELECT msg_id, {_DECISION} AS is_decision FROM said")
def _(s, d):
    return said(s, d).select("msg_id", text.is_decision(F.col("text")).alias("is_decision"))


def _mood_sql() -> str:
    out = []
    for name in lexicon.MOOD_ORDER:
        for w in sorted(lexicon.MOODS[name], key=len, reverse=True):
            at = f"instr(lower(text), {_q(w.lower())})"
            hit = f"{at} > 0"
            if name == lexicon.HAPPY:
                before = f"substring(lower(text), greatest({at} - 8, 1), {at} - greatest({at} - 8, 1))"
                hit += f" AND len(list_filter([{', '.join(map(_q, lexicon.NEGATORS))}], lambda n: contains({before}, n))) = 0"
            out.append(f"WHEN {hit} THEN {_q(name)}")
    return "CASE " + " ".join(out) + " ELSE '' END"


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN {_q(k)}" for k, p in lexicon.MEMORY_TYPES.items()) + " ELSE 'semantic' END"
_D = lexicon.DRIFT
_DRIFT = f"""(CASE WHEN {_any(_D['give_up'])} THEN -100 WHEN {_any(_D['compromise'])} THEN -60 WHEN {_any(_D['annoyed'])} THEN -30
  WHEN {_count(_D['spend'])} > {_count(_D['frugal'])} THEN -20 * ({_count(_D['spend'])} - {_count(_D['frugal'])}) WHEN {_count(_D['frugal'])} > 0 THEN 15 * {_count(_D['frugal'])} ELSE 0 END)::INT"""


@query("said_signals", f"WITH {_SAID} SELECT msg_id, {_DECISION} AS is_decision, {_mood_sql()} AS mood, {_TYPE} AS memory_type, {_DRIFT} AS drift FROM said WHERE sender IS NOT NULL")
def _(s, d):
    return decorate(said(s, d)).select("msg_id", "is_decision", "mood", "memory_type", "drift")


def _found(patterns) -> str:
    return "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(text, {_q(p)}, 1), lambda x: trim(x))" for p in patterns) + ")"


@query(
    "said_choices",
    f"""WITH {_SAID}, c AS (SELECT msg_id, list_concat(list_filter({_found(lexicon.CHOICES)}, lambda x: length(x) >= 1 AND lower(x) NOT IN ({', '.join(map(_q, lexicon.NO_CHOICE))})),
  list_filter({_found(lexicon.ACTIONS)}, lambda x: length(x) >= 2), list_filter([{', '.join(map(_q, lexicon.GIVE_UP))}], lambda w: contains(text, w))) AS c FROM said)
SELECT msg_id, len(c)::INT AS n, array_to_string(c, '|') AS choices, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), ' → ') AS told FROM c""",
)
def _(s, d):
    c = said(s, d).select("msg_id", text.choice_chain(F.col("text")).alias("c"))
    told = F.split(text.chain_summary(F.col("c")), "  回到")[0]
    return c.select("msg_id", F.size("c").alias("n"), F.array_join("c", "|").alias("choices"), told.alias("told"))


def _clean(x: str) -> str:
    bare = f"regexp_replace(trim({x}), {_q(lexicon.LEADING_PARTICLE)}, '')"
    return f"CASE WHEN length({bare}) >= 2 THEN {bare} END"


def _unicode(p: str) -> str:
    return _q(p.replace(r"\w", r"\p{L}\p{N}_"))


_TRIPLES = " UNION ALL ".join(
    [f"SELECT msg_id, 'subject' AS subject, {_q(r)} AS relation, {_clean('x')} AS object FROM (SELECT msg_id, unnest(regexp_extract_all(text, {_unicode(p)}, 1)) AS x FROM said)" for p, r in lexicon.RELATIONS if re.compile(p).groups == 1]
    + [f"SELECT msg_id, {_clean('x')}, {_q(r)}, {_clean('y')} FROM (SELECT msg_id, unnest(regexp_extract_all(text, {_unicode(p)}, 1)) AS x, unnest(regexp_extract_all(text, {_unicode(p)}, 2)) AS y FROM said)" for p, r in lexicon.RELATIONS if re.compile(p).groups == 2]
)


@query("said_triples", f"WITH {_SAID}, t AS ({_TRIPLES}) SELECT * FROM t WHERE subject IS NOT NULL AND object IS NOT NULL")
def _(s, d):
    return graph.extract(said(s, d))


def _entity(x: str) -> str:
    bare = rf"regexp_replace({x}, '^[\s，。；;、]+|[\s，。；;、]+$', '', 'g')"
    return f"CASE {bare} " + " ".join(f"WHEN {_q(a)} THEN {_q(n)}" for a, n in lexicon.ALIASES.items()) + f" ELSE {bare} END"


_FACTS = " UNION ".join(
    [f"SELECT msg_id, {_entity('a')} AS subject, trim(b) AS relation, {_entity('o')} AS object FROM (SELECT msg_id, " + ", ".join(f"unnest(regexp_extract_all(text, {_q(p)}, {g})) AS {c}" for g, c in ((1, "a"), (2, "b"), (3, "o"))) + " FROM said)" for p in lexicon.FACT_THREE]
    + [f"SELECT msg_id, {_entity('a')}, {_q(lexicon.FACT_RELATION)}, {_entity('o')} FROM (SELECT msg_id, " + ", ".join(f"unnest(regexp_extract_all(text, {_q(p)}, {g})) AS {c}" for g, c in ((1, "a"), (2, "o"))) + " FROM said)" for p in lexicon.FACT_TWO]
)


@query("said_facts", f"WITH {_SAID} {_FACTS}")
def _(s, d):
    return said(s, d).select("msg_id", F.inline(text.facts(F.col("text"))))


@query(
    "density_tokens",
    f"""WITH {_SAID}, w AS (SELECT msg_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS ws, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') AS runs FROM said),
g AS (SELECT msg_id, list_distinct(list_concat(flatten(list_transform(runs, lambda r: list_transform(range(1, length(r)), lambda i: r[i:i+1]))), ws, flatten(list_transform(ws, lambda w: list_concat(list_transform(range(1, length(w)), lambda i: w[i:i+1]), list_transform(range(1, length(w) - 1), lambda i: w[i:i+2])))))) AS t FROM w)
SELECT msg_id, len(t)::INT AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM g""",
)
def _(s, d):
    return said(s, d).select("msg_id", text.density_tokens(F.col("text")).alias("t")).select("msg_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("line_hash", f"WITH {v.CORPUS} SELECT msg_id, substring(sha256(substring(text, 1, 300)), 1, 8) AS hash FROM corpus")
def _(s, d):
    return v.corpus(s, d).select("msg_id", text.line_hash(F.col("text")).alias("hash"))


_YEARS = r"""CASE WHEN regexp_extract(p, '大概(\d{1,2})年前', 1) <> '' THEN range(2024 - regexp_extract(p, '大概(\d{1,2})年前', 1)::INT - 1, 2024 - regexp_extract(p, '大概(\d{1,2})年前', 1)::INT + 2)
 WHEN regexp_extract(p, '最近(\d{1,2})年', 1) <> '' THEN range(2024 - regexp_extract(p, '最近(\d{1,2})年', 1)::INT, 2025) WHEN contains(p, '前年') THEN [2022] WHEN regexp_matches(p, '去年|last year') THEN [2023] WHEN regexp_matches(p, '今年|this year') THEN [2024] ELSE [] END"""


_PHRASE = "CASE {key} % 7 WHEN 0 THEN {ago} WHEN 1 THEN {last} WHEN 2 THEN '前年夏天' WHEN 3 THEN '去年 or last year' WHEN 4 THEN 'this year' WHEN 5 THEN '今年' ELSE o_orderpriority END"


@query("years_of_phrases", f"WITH t AS (SELECT o_orderkey, {_PHRASE.format(key='o_orderkey', ago="'大概' || (o_custkey % 30 + 1) || '年前去过'", last="'最近' || (o_custkey % 12 + 1) || '年的账'")} AS p FROM orders) SELECT o_orderkey, p AS phrase, array_to_string({_YEARS}, ' ') AS years FROM t")
def _(s, d):
    phrase = F.expr(_PHRASE.format(key="o_orderkey", ago="concat('大概', o_custkey % 30 + 1, '年前去过')", last="concat('最近', o_custkey % 12 + 1, '年的账')"))
    t = v.read(s, d, "orders").select("o_orderkey", phrase.alias("phrase"))
    return t.select("o_orderkey", "phrase", F.array_join(F.transform(text.years(F.col("phrase"), 2024), lambda y: y.cast("string")), " ").alias("years"))


@query("md_sections", f"WITH {v.CORPUS}, m AS (SELECT msg_id, '# log' || chr(10) || '## First' || chr(10) || text || chr(10) || '## Second part' || chr(10) || lang || chr(10) AS t FROM corpus) SELECT msg_id, md5(trim(regexp_extract(t, '(?s)(?:^|\\n)## First[^\\n]*\\n(.*?)(?:\\n## |\\z)', 1))) AS first, trim(lang) AS second FROM m JOIN corpus USING (msg_id)")
def _(s, d):
    t = F.concat(F.lit("# log\n## First\n"), "text", F.lit("\n## Second part\n"), "lang", F.lit("\n"))
    m = v.corpus(s, d).select("msg_id", t.alias("t"))
    return m.select("msg_id", F.md5(text.md_section(F.col("t"), "First")).alias("first"), F.regexp_replace(text.md_section(F.col("t"), "Second part"), "\n", "").alias("second"))


_LINES = ("no bars at all", "2024-01-01 00:00:00 | user", "not a time | user | text | with bars", "2024-01-01 00:00:00 | agent | ok | still text")
_FLAT = "regexp_replace(text, '[\\n\\r]', ' ', 'g')"


@query(
    "log_lines",
    f"""WITH {v.MESSAGES}, l AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || sender || ' | ' || {_FLAT} AS line FROM messages UNION ALL SELECT * FROM (VALUES {', '.join(f'({_q(x)})' for x in _LINES)}) t(line)),
p AS (SELECT line, string_split(line, ' | ') AS s FROM l)
SELECT len(s) >= 3 AS valid, coalesce(strftime(try_strptime(s[1], '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'), '') AS ts, coalesce(s[2], '') AS sender, md5(array_to_string(s[3:], ' | ')) AS digest, count(*) AS n FROM p GROUP BY ALL""",
)
def _(s, d):
    line = F.concat_ws(" | ", F.date_format("ts", readers.TS), "sender", F.regexp_replace("text", r"[\n\r]", " "))
    lines = v.messages(s, d).select(line.alias("value")).unionAll(s.createDataFrame([(x,) for x in _LINES], "value string"))
    p = readers.parse_lines(lines)
    stamp = F.coalesce(F.date_format("ts", readers.TS), F.lit(""))
    return p.groupBy("valid", stamp.alias("ts"), F.coalesce("sender", F.lit("")).alias("sender"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(F.count("*").alias("n"))


@query("scene_history", f"WITH {v.DECISIONS} SELECT stage, scene, count(*) AS n, min(event_id) AS first_id FROM decisions GROUP BY ALL")
def _(s, d):
    return v.decisions(s, d).groupBy("stage", "scene").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("tasks_pending", "WITH l AS (SELECT o_custkey AS task, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'pending' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT task, seq FROM l WHERE status = 'pending'")
def _(s, d):
    o = v.read(s, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), "o_orderdate")
    return state.latest(o, "task", ["o_orderdate", "seq"]).where("status = 'pending'").select("task", "seq")


@query("current_stage", f"WITH {v.DECISIONS} SELECT user_id, arg_max(stage, (ts, event_id)) AS stage, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since FROM decisions GROUP BY 1")
def _(s, d):
    return v.decisions(s, d).groupBy("user_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.date_format(F.max("ts"), readers.TS).alias("since"))


_LEADERS = f"""WITH RECURSIVE {v.MEMORIES}, m AS (SELECT memory_id, type, embedding FROM memories WHERE type IN ('episodic', 'emotional')),
p AS (SELECT a.memory_id AS a, b.memory_id AS b FROM m a JOIN m b USING (type) WHERE a.memory_id < b.memory_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {{least}}),
k AS (SELECT memory_id AS node, row_number() OVER (ORDER BY memory_id) AS k, coalesce(near, []) AS near FROM m LEFT JOIN (SELECT b, list(a) AS near FROM p GROUP BY b) ON b = memory_id),
r(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT r.k + 1, CASE WHEN len(list_intersect(leaders, near)) = 0 THEN list_append(leaders, node) ELSE leaders END FROM r JOIN k ON k.k = r.k + 1),
done AS (SELECT leaders FROM r ORDER BY k DESC LIMIT 1)
SELECT node, CASE WHEN list_contains(leaders, node) THEN node ELSE list_min(list_intersect(near, leaders)) END AS leader FROM k, done"""


@query("mem_consolidate", _LEADERS.format(least=0.8))
def _(s, d):
    return memory.consolidate(v.memories(s, d).where("type in ('episodic', 'emotional')"))


@query("mem_leaders", _LEADERS.format(least=0.3))
def _(s, d):
    # the tables' vectors are far apart: at 0.3 some are similar, and leaders lead
    return memory.consolidate(v.memories(s, d).where("type in ('episodic', 'emotional')"), 0.3)


@query("words_of_stated", f"WITH {_SAID} SELECT msg_id, array_to_string({_WORDS_SQL}, ' ') AS tokens FROM said")
def _(s, d):
    return said(s, d).select("msg_id", F.array_join(text.words(F.col("text")), " ").alias("tokens"))
