"""The queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from . import quality

#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, and the lower case of A-Z alone.
SOLID, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either_case(words: str) -> str:
    """Letters in either case, without Unicode's folding (where ſ is an s)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def secrets_sql() -> str:
    kinds = (
        ("assign", f"""({_either_case('password|passwd|secret|token|api_?key')})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "(AKIA[A-Z0-9]+)", 1, 18),
        ("hex", "([0-9a-f]+)", 1, 16),
    )
    parts = [
        f"""SELECT rid, {k} AS k, '{name}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS bs,
 regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS gs FROM d"""
        for k, (name, p, group, least) in enumerate(kinds)
    ]
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
e AS (SELECT rid, k, kind, least, i, length(bs[i]) + length(ms[i]) AS step, length(ms[i]) AS m, length(gs[i]) AS g FROM x, unnest(range(1, len(ms) + 1)) AS u(i)),
p AS (SELECT *, sum(step) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM e),
s AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 string_agg(kind || ':' || (stop - m)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - m, k) AS spans FROM p WHERE g >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN s USING (rid)"""


def decontaminate_sql() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) + 1)) AS u(i) WHERE i + n - 1 <= len(w)),
m AS (SELECT rid, i, n, item FROM dw JOIN iw USING (n, s)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""


def jaccard_sql() -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '{SOLID}') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid < y.rid GROUP BY x.rid, y.rid),
l AS (SELECT a, b FROM pairs JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (rid)
 JOIN (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a) c USING (rid)"""


def quality_sql(alpha: float = 0.05, delta: float = 0.05, max_strata: int = 64) -> str:
    rate = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "chars_per_word": "word_chars / greatest(n_words, 1)",
    }
    level = ", ".join(f"len(list_filter({[*quality.GRIDS[r]]}::DOUBLE[], lambda c: {x} <= c))" for r, x in rate.items())
    chars = lambda c: f"length(t) - length(translate(t, '{c}', ''))"
    tail = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha}))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SOLID}') AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SOLID}')) AS ls FROM documents),
g AS (SELECT rid, g, list(i) AS places FROM (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)) GROUP BY rid, g HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, unnest(places) AS i FROM g)) GROUP BY rid),
f AS (SELECT rid, doc_id, coalesce(lang, '') AS s, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {chars(quality._SYMBOLS)} AS n_symbols,
 {chars(quality._UPPER)} AS n_upper, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, least({level}) AS level FROM f),
y AS (SELECT s, level, count(*) OVER (PARTITION BY s) AS ns FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) > 0)),
o AS (SELECT CASE WHEN dense_rank() OVER (ORDER BY ns DESC, s) <= {max_strata} THEN s END AS s, level FROM y),
k AS (SELECT s, i, count(*) AS n, count(*) FILTER (level <= i) AS k FROM o, range({quality.LEVELS}) AS u(i) GROUP BY s, i),
p AS (SELECT s, i, n = k OR sum({tail}) <= {delta} / (SELECT count(DISTINCT coalesce(s, '') || (s IS NULL)) FROM k) AS ok FROM k, unnest(range(0, k + 1)) AS u(j) GROUP BY s, i, n, k),
a AS (SELECT s, coalesce(min(i) FILTER (NOT ok), {quality.LEVELS}) AS steps FROM p GROUP BY s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND level >= coalesce((SELECT steps FROM a WHERE a.s = v.s), (SELECT steps FROM a WHERE a.s IS NULL), 0) AS kept FROM v"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets_sql(), "op3_decontaminate": decontaminate_sql(), "op5_jaccard": jaccard_sql(), "op9_quality": quality_sql()}
