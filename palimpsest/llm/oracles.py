"""DuckDB texts of the operators' queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from .quality_rules import MIN_WORDS, MOST_REPEATED, PRIOR, RULES

_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_WS = "d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, " + _SPLIT.format("coalesce(text, '')") + " AS ws FROM documents)"

_METRICS = {"marks": ("n_marks", "word_chars"), "word_size": ("word_chars", "n_words"), "again": ("n_words - n_distinct", "n_words")}


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN floor(1000000 * ({a}) / {b}) ELSE 0 END::BIGINT"


def _bin(m: str) -> str:
    return f"CASE WHEN {m} < 256 THEN {m} ELSE length(bin({m})) * 256 + floor({m} / pow(2.0, length(bin({m})) - 8)) END::INT"


_TOP = "CASE WHEN bin < 256 THEN bin::DOUBLE ELSE (bin % 256 + 1) * pow(2.0, floor(bin / 256.0) - 8) - 1 END"


def _quartiles(name: str, keys: list[str]) -> str:
    by = ", ".join([*keys, "metric"])
    return (
        f"{name} AS (SELECT {by}, any_value(total)::DOUBLE AS total, min(top) FILTER (WHERE seen >= total * 0.25) AS low, min(top) FILTER (WHERE seen >= total * 0.75) AS high "
        f"FROM (SELECT {by}, {_TOP} AS top, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bin, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL)"
    )


def _weighed(of: str, own: str, prior: str) -> str:
    p = f"{float(PRIOR)}::DOUBLE"
    return f"({own}.total * {own}.{of} + {p} * {prior}.{of}) / ({own}.total + {p}) AS {of}"


def _limits() -> dict[str, str]:
    out = {}
    for m, (floor, below, above) in RULES.items():
        spread = f"greatest(high - low, {float(floor)}::DOUBLE)"
        if below is not None:
            out[f"min_{m}"] = f"max(CASE WHEN metric = '{m}' THEN low - {below}::DOUBLE * {spread} END)"
        if above is not None:
            out[f"max_{m}"] = f"max(CASE WHEN metric = '{m}' THEN high + {above}::DOUBLE * {spread} END)"
    return out


QUALITY_RULES = (
    f"WITH {_WS}, win AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)), "
    "rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)) GROUP BY 1), "
    r"ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d), "
    r"f AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, "
    r"length(text) - length(regexp_replace(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks, "
    "(len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_distinct(ws)) AS n_distinct FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)), "
    "m AS (SELECT *, " + ", ".join(f"{_share(*p)} AS {k}" for k, p in _METRICS.items()) + " FROM f), "
    "sk AS (" + " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {_bin(k)} AS bin, count(*) AS n FROM m GROUP BY ALL" for k in RULES) + "), "
    f"{_quartiles('g', ['lang', 'source'])}, {_quartiles('l0', ['lang'])}, {_quartiles('a', [])}, "
    f"l AS (SELECT l0.lang, l0.metric, {_weighed('low', 'l0', 'a')}, {_weighed('high', 'l0', 'a')} FROM l0 JOIN a ON l0.metric = a.metric), "
    f"lim AS (SELECT g.lang, g.source, g.metric, {_weighed('low', 'g', 'l')}, {_weighed('high', 'g', 'l')} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.metric = l.metric), "
    "p AS (SELECT lang, source, " + ", ".join(f"{x} AS {k}" for k, x in _limits().items()) + " FROM lim GROUP BY ALL), "
    f"j AS (SELECT m.*, p.* EXCLUDE (lang, source), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m JOIN p ON m.lang IS NOT DISTINCT FROM p.lang AND m.source IS NOT DISTINCT FROM p.source) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND " + " AND ".join(f"{k[4:]} {'>=' if k.startswith('min_') else '<='} {k}" for k in _limits()) + " AS kept, " + ", ".join([*RULES, *_limits()]) + " FROM j"
)

SUBSTRINGS = f"""
WITH {_WS}, win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (s) WHERE doc_id > first_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_ >= 85 * (nx.n + ny.n - both_)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT x, x FROM u UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.reached),
c AS (SELECT doc_id, min(reached) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
