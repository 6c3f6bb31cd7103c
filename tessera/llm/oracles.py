"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessera.llm.lines import MIN_WORDS
from tessera.llm.quality import RULES, STOP_WORDS

_WS = r"\x20\x09-\x0D"


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        if r.low is not None:
            parts.append(f"({r.metric} < {float(r.low)}::double)")
        if r.high is not None:
            parts.append(f"({r.metric} > {float(r.high)}::double)")
    return " OR ".join(parts)


def _names_sql() -> str:
    parts = []
    for r in RULES:
        tests = [f"{m} {o} {float(b)}::double" for m, o, b in ((r.metric, "<", r.low), (r.metric, ">", r.high)) if b is not None]
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.metric}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


def _share(top: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {top}::double / {base} ELSE 0.0::double END"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP2 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^{_WS}]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_WS}]')) AS l FROM t),
tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, unnest([0, 1, 2]) AS v(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOPS}))) AS n_stop_words,
         length(t) - length(replace(t, '!', '')) AS n_bangs,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}{{2}}') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[{_WS}]*$'))) AS n_ellipsis_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[{_WS}]*[-*•]'))) AS n_bullet_lines
  FROM w LEFT JOIN cov USING (rid)),
r AS (
  SELECT doc_id, n_words AS words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words::double AS n_words,
         {_share('word_chars', 'n_words')} AS mean_word_chars, {_share('n_symbols', 'n_words')} AS symbols_per_word,
         {_share('n_bangs', 'n_words')} AS bangs_per_word, {_share('n_upper_words', 'n_words')} AS upper_words_share,
         {_share('n_stop_words', 'n_words')} AS stop_words_share, {_share('n_dup_lines', 'n_lines')} AS dup_lines_share,
         {_share('n_ellipsis_lines', 'n_lines')} AS ellipsis_lines_share, {_share('n_bullet_lines', 'n_lines')} AS bullet_lines_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, words::bigint AS n_words, word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
       n_repeat_words::bigint AS n_repeat_words, base_failed, NOT base_failed AND NOT ({_rules_sql()}) AS kept,
       {_names_sql()} AS broken_rules
FROM r
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_WS}]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(d, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT documents.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, coalesce(m.c, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.d = documents.doc_id
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM p
QUALIFY rank <= 20
"""

OP4 = rf"""
WITH l AS (
  SELECT doc_id AS d, i, line, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents WHERE doc_id IS NOT NULL)
  WHERE regexp_matches(line, '[^{_WS}]')),
long AS (SELECT * FROM l WHERE n >= {MIN_WORDS}),
v AS (
  SELECT d, i, n, j, array_to_string(list_concat(w[1 : j - 1], w[j + 1 : n]), ' ') AS k FROM long, unnest(range(1, n + 1)) AS u(j)),
gone AS (
  SELECT d, i FROM l QUALIFY (d, i) > min((d, i)) OVER (PARTITION BY line)
  UNION SELECT d, i FROM v QUALIFY (d, i) > min((d, i)) OVER (PARTITION BY k, j, n)
  UNION SELECT v.d, v.i FROM v JOIN long t ON v.k = t.line AND v.n = t.n + 1 WHERE (v.d, v.i) > (t.d, t.i)
  UNION SELECT t.d, t.i FROM v JOIN long t ON v.k = t.line AND v.n = t.n + 1 WHERE (t.d, t.i) > (v.d, v.i)),
g AS (SELECT d, list(i) AS gone FROM gone GROUP BY d)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)),
            lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text,
       len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')))::bigint AS n_lines,
       coalesce(len(gone), 0)::bigint AS n_removed
FROM documents LEFT JOIN g ON doc_id = d
"""

OP5 = rf"""
WITH z AS (
  SELECT doc_id AS d, source AS s, len(regexp_extract_all(coalesce(text, ''), '[^{_WS}]+'))::bigint AS z FROM documents),
src AS (
  SELECT s, n, [3, 1, 2][((row_number() OVER (ORDER BY s ASC NULLS LAST) - 1) % 3 + 1)::int] AS w,
         (CAST([-0.5, 0.0, 0.5] AS double[]))[((row_number() OVER (ORDER BY s ASC NULLS LAST) - 1) % 3 + 1)::int] AS b
  FROM (SELECT s, sum(z)::bigint AS n FROM z GROUP BY s)),
lv AS (
  SELECT *, (n * 2)::double / w AS r,
         (sum(n) OVER ())::double * 1.5::double - 2 * coalesce(sum(n) OVER o, 0)::double AS remain,
         (sum(w) OVER ()) - coalesce(sum(w) OVER o, 0) AS w_left
  FROM src WINDOW o AS (ORDER BY (n * 2)::double / w, s ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min(remain / w_left, r) AS level FROM lv WHERE remain / w_left <= r),
t AS (
  SELECT s, n, b, CASE WHEN level IS NULL OR n * 2 <= w * level THEN (n * 2)::double ELSE w * level END AS target FROM lv, lev),
x AS (
  SELECT d, z.s, z, n, b, target, md5(coalesce(d::varchar, '')) AS h, z * 100 > n AS big,
         greatest(0.0::double, least(target, n::double)) AS b0, greatest(0.0::double, least(target - n, n::double)) AS b1
  FROM z JOIN t ON z.s IS NOT DISTINCT FROM t.s),
p AS (
  SELECT *, coalesce(sum(z) OVER (PARTITION BY s, big ORDER BY CASE WHEN big THEN -z ELSE 0 END, h, d, z
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pre FROM x),
hd AS (
  SELECT s, coalesce(max(CASE WHEN pre + z <= b0 THEN pre + z END), 0) AS l0, coalesce(max(CASE WHEN pre + z <= b1 THEN pre + z END), 0) AS l1
  FROM p WHERE big GROUP BY s),
y AS (SELECT p.*, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1 FROM p LEFT JOIN hd ON p.s IS NOT DISTINCT FROM hd.s),
c AS (
  SELECT *, CASE WHEN big THEN pre + z <= l0 ELSE l0 + pre + z / 2.0::double <= b0 END AND z > 0 AS c0,
         CASE WHEN big THEN pre + z <= l1 ELSE l1 + pre + z / 2.0::double <= b1 END AND z > 0 AS c1,
         least(1.0::double, (pre + CASE WHEN big THEN 0 ELSE l0 END + z / 2.0::double) / target) AS u0,
         least(1.0::double, (n + pre + CASE WHEN big THEN 0 ELSE l1 END + z / 2.0::double) / target) AS u1
  FROM y)
SELECT d AS doc_id, z AS size, n AS source_size, target, z * (c0::int + c1::int) AS taken,
       round(CASE WHEN c0 THEN 2 * u0 / (1 - b + sqrt((1 - b) * (1 - b) + 4 * b * u0))
                  WHEN c1 THEN 2 * u1 / (1 - b + sqrt((1 - b) * (1 - b) + 4 * b * u1)) END, 9) AS first_position
FROM c
"""

SQL: dict[str, str] = {"op2_quality_rules": OP2, "op3_ngram_jaccard_join": OP3, "op4_line_dedup": OP4, "op5_mixing_sources": OP5, "op9_exact_topk": OP9}
