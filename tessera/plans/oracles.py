"""DuckDB SQL twins of the queries, put together from shared common table expressions."""

from __future__ import annotations

from tessera.functions.text import TOKEN, WHITE
from tessera.plans.fixtures import QUERY_CHARS, SMALL
from tessera.plans.queries import DESCRIPTION, FEW

C = SMALL


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '{WHITE}', ' ', 'g'))"


def toks(x: str, limit: int | None = None) -> str:
    inner = norm(x) if limit is None else f"substring({norm(x)}, 1, {limit})"
    return f"regexp_extract_all({inner}, '{TOKEN}')"


ITEMS = """items AS (
  SELECT documents.doc_id AS doc, documents.doc_id::varchar AS item_id, string_split(text, chr(10))[1] AS title, lang || ' ' || source AS params,
         text AS description, regexp_extract(source, '([0-9]+)$', 1)::bigint AS item_location_id,
         CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END::bigint AS item_category_id,
         quality::double AS item_rating, n_chars::double AS reviews, toxic::double AS toxic, n_chars::double AS price
  FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id)"""


def queries_cte(chars: int = QUERY_CHARS) -> str:
    return f"""queries AS (
  SELECT item_id::varchar AS query_id, substring(text, 1, {chars}) AS search_query, item_id % 20 AS search_location_id,
         'src' || (item_id % 20)::varchar AS search_infm_params_text, item_id % 5 AS search_category, item_id FROM benchmark)"""


POSITIVES = "positives AS (SELECT item_id::varchar AS query_id, doc_id AS doc FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"


def index_ctes(c=C) -> str:
    fields = " UNION ALL ".join(f"SELECT '{f.column}' AS field, doc, {toks(f.column, f.limit)} AS t FROM items" for f in c.fields)
    return f"""tok AS ({fields}),
stats AS (SELECT field, count(*) AS n, coalesce(nullif(sum(len(t))::double / count(*), 0), 1) AS average FROM tok GROUP BY field),
tf AS (SELECT field, doc, len, term, count(*) AS tf FROM (SELECT field, doc, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
idx AS (
  SELECT field, term, doc, tf, df, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) AS idf,
         ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * ({c.k1}::double + 1)
           / (tf + {c.k1}::double * ({1 - c.b}::double + {c.b}::double * len / average)) AS weight
  FROM tf JOIN df USING (field, term) JOIN stats USING (field))"""


def lexical_ctes(c=C, filters: bool = True) -> str:
    extra = f"UNION ALL SELECT query_id, unnest(list_distinct({toks('search_infm_params_text')})), {c.filter_weight}::double FROM queries" if filters else ""
    weights = " ".join(f"WHEN '{f.column}' THEN {f.weight}::double" for f in c.fields)
    return f"""qt AS (
  SELECT query_id, term, sum(w) AS w FROM (
    SELECT query_id, unnest(list_distinct({toks('search_query')})) AS term, 1::double AS w FROM queries {extra}) GROUP BY ALL),
lex AS (SELECT query_id, doc, sum(CASE field {weights} END * w * weight) AS lexical FROM qt JOIN idx USING (term) GROUP BY ALL)"""


def edges_ctes(pairs: str, c=C) -> str:
    return f"""pairs AS ({pairs}),
pc AS (SELECT source, target, count(*) AS count FROM pairs GROUP BY ALL),
sc AS (SELECT source, count(*) AS sources FROM pairs GROUP BY ALL),
tc AS (SELECT target, count(*) AS targets FROM pairs GROUP BY ALL),
ec AS (
  SELECT source, target, count, targets::double / (SELECT count(*) FROM pairs) AS prior, sources
  FROM pc JOIN sc USING (source) JOIN tc USING (target)),
ed AS (
  SELECT source, target, count, greatest(0::double, (given - prior) / (given + prior)) * (count / (count + {c.support_weight}::double)) AS signal
  FROM (SELECT *, (count + {c.prior_weight}::double * prior) / (sources + {c.prior_weight}::double) AS given FROM ec)
  WHERE source <> target AND sources >= {c.min_sources} AND count >= {c.min_count}),
edges AS (SELECT * FROM ed WHERE signal > 0),
linked AS (
  SELECT source, target, rank FROM (
    SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY signal DESC, count DESC, target) AS rank
    FROM edges WHERE signal >= {c.min_signal}::double) WHERE rank <= {c.linked_locations})"""


NATIONS = """SELECT c_nationkey::bigint AS source, s_nationkey::bigint AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""
ROLES = "SELECT a.role AS source, b.role AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def placed_ctes(c=C) -> str:
    return f"""placed AS (
  SELECT lex.query_id, lex.doc, lexical, coalesce(search_location_id = item_location_id, false) AS exact,
         coalesce(search_category <> 0 AND search_category = item_category_id, false) AS category, coalesce(signal, 0) AS signal
  FROM lex JOIN queries USING (query_id) JOIN items USING (doc)
  LEFT JOIN edges ON source = search_location_id AND target = item_location_id),
scored AS (
  SELECT *, round(lexical * CASE WHEN exact THEN {c.exact_location}::double ELSE 1 END * CASE WHEN category THEN {c.category}::double ELSE 1 END
                  * (1 + {c.transition_strength}::double * signal), 6) AS score FROM placed)"""


def best(source: str, k: int, score: str = "score", cols: str = "query_id, doc") -> str:
    return f"SELECT {cols}, {score} AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc))::int AS rank FROM {source}) WHERE rank <= {k}"


GEO = ",\n".join([ITEMS, queries_cte(), index_ctes(), lexical_ctes(), edges_ctes(NATIONS), placed_ctes()])

CANDIDATES = f"""{GEO},
nv AS (SELECT count(*) AS n FROM embeddings),
qv AS (SELECT queries.*, embedding AS q_vec FROM queries, nv JOIN embeddings ON vec_id = queries.item_id % n),
iv AS (SELECT items.*, embedding AS d_vec FROM items, nv JOIN embeddings ON vec_id = items.doc % n),
cosines AS (
  SELECT query_id, doc, round(list_inner_product(q_vec::double[], d_vec::double[]), 6) + 0 AS score, search_location_id, item_location_id FROM qv, iv),
cand AS (
  SELECT query_id, doc, 'bm25' AS channel, rank FROM ({best('scored', 50)})
  UNION ALL SELECT query_id, doc, 'global', rank FROM ({best('cosines', 100)})
  UNION ALL SELECT query_id, doc, 'exact', rank FROM ({best('(SELECT * FROM cosines WHERE search_location_id = item_location_id)', 20)})
  UNION ALL SELECT query_id, doc, 'transition', rank
    FROM ({best('(SELECT cosines.* FROM cosines JOIN linked ON source = search_location_id AND target = item_location_id)', 10)})),
pool AS (
  SELECT query_id, doc, count(*)::int AS channel_count, round(sum(1::double / ({C.rrf} + rank)), 9) AS rrf,
         min(CASE channel WHEN 'bm25' THEN rank END) AS bm25_at, min(CASE channel WHEN 'global' THEN rank END) AS global_at,
         min(CASE channel WHEN 'exact' THEN rank END) AS exact_at, min(CASE channel WHEN 'transition' THEN rank END) AS transition_at
  FROM cand GROUP BY query_id, doc)"""

_RANKS = ",\n         ".join(f"coalesce({n}_at, {C.missing_rank})::double AS {n}_rank, coalesce(1::double / {n}_at, 0) AS {n}_rr, ({n}_at IS NOT NULL)::int::double AS {n}_present" for n in ("bm25", "global", "exact", "transition"))
_T, _P, _D = C.fields

FEATURES = f"""WITH {CANDIDATES},
it AS (
  SELECT doc, list_distinct({toks('title', _T.limit)}) AS t_tok, list_distinct({toks('params', _P.limit)}) AS p_tok,
         list_distinct({toks('description', _D.limit)}) AS d_tok FROM items),
qs AS (
  SELECT query_id, list_distinct({toks('search_query')}) AS q_tok, list_distinct({toks('search_infm_params_text')}) AS f_tok,
         length(search_query)::double AS query_chars FROM queries),
pl AS (
  SELECT pool.*, coalesce(lexical, 0) AS lexical, coalesce(queries.search_location_id = i.item_location_id, false) AS exact,
         coalesce(search_category <> 0 AND search_category = i.item_category_id, false) AS category, coalesce(signal, 0) AS signal,
         q_tok, f_tok, query_chars, t_tok, p_tok, d_tok, item_rating, reviews, toxic, price, cosines.score AS cos
  FROM pool LEFT JOIN lex USING (query_id, doc) JOIN queries USING (query_id) JOIN items i USING (doc)
  LEFT JOIN edges ON source = queries.search_location_id AND target = i.item_location_id
  JOIN it USING (doc) JOIN qs USING (query_id) JOIN cosines USING (query_id, doc)),
x AS (
  SELECT *, round(lexical * CASE WHEN exact THEN {C.exact_location}::double ELSE 1 END * CASE WHEN category THEN {C.category}::double ELSE 1 END
                  * (1 + {C.transition_strength}::double * signal), 6) AS score,
         len(list_intersect(q_tok, t_tok))::double AS title, len(list_intersect(q_tok, p_tok))::double AS prm,
         len(q_tok)::double AS q_len FROM pl)
SELECT query_id, doc, round(score, 6) AS bm25_score,
       round(score / greatest(max(score) OVER q, 1e-6::double), 6) AS bm25_relative,
       round(score / CASE WHEN exact THEN {C.exact_location}::double ELSE 1 END / (1 + {C.transition_strength}::double * signal)
             / CASE WHEN category THEN {C.category}::double ELSE 1 END, 6) AS lexical_score,
       cos AS cosine, round(cos - max(cos) OVER q, 6) AS cosine_gap_to_best,
       round((cos - min(cos) OVER q) / greatest(max(cos) OVER q - min(cos) OVER q, 1e-6::double), 6) AS cosine_range_normalized,
         {_RANKS},
       channel_count::double AS channel_count, exact::int::double AS exact_location, round(signal, 6) AS transition_signal,
       category::int::double AS category_match, title AS query_title_overlap, round(title / greatest(q_len, 1), 6) AS query_title_coverage,
       round(title / greatest(len(t_tok), 1)::double, 6) AS title_query_coverage, prm AS query_params_overlap,
       round(prm / greatest(q_len, 1), 6) AS query_params_coverage,
       round(len(list_intersect(q_tok, d_tok))::double / greatest(q_len, 1), 6) AS query_description_coverage,
       round(len(list_intersect(f_tok, p_tok))::double / greatest(len(f_tok), 1)::double, 6) AS filter_params_coverage,
       q_len AS query_tokens, query_chars, len(f_tok)::double AS filter_tokens, len(t_tok)::double AS title_tokens,
       len(p_tok)::double AS params_tokens, item_rating, round(ln(1 + greatest(0::double, reviews)), 6) AS log_reviews,
       toxic AS phone_hidden, toxic AS message_forbidden, round(ln(1 + greatest(0::double, price)), 6) AS log_price
FROM x WINDOW q AS (PARTITION BY query_id)
"""

LABELLED = f"""WITH {CANDIDATES},
{POSITIVES},
lab AS (SELECT pool.*, (p.doc IS NOT NULL)::int AS label FROM pool LEFT JOIN positives p USING (query_id, doc)),
found AS (SELECT DISTINCT query_id FROM lab WHERE label = 1),
ms AS (SELECT *, round(rrf * 10 - coalesce(bm25_at, 100)::double / 1000, 9) AS model_score FROM lab)"""

_HEAD = " OR ".join(f"coalesce({n}_at <= {FEW.channel_head}, false)" for n in ("bm25", "global", "exact", "transition"))


def _filled(required: str, source: str) -> str:
    return f"""SELECT query_id, doc, label FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY required DESC, rrf DESC, doc) AS n, sum(required::int) OVER (PARTITION BY query_id) AS need
  FROM (SELECT *, {required} AS required FROM {source})) WHERE n <= greatest(need, {FEW.sampled})"""


GROUPS = f"""keys AS (SELECT DISTINCT {norm('text')} AS search_query, role, conv_id FROM conversations),
g AS (
  SELECT search_query, role, string_agg(conv_id::varchar, ' ' ORDER BY conv_id) AS positives FROM keys GROUP BY ALL),
groups AS (
  SELECT sha256('[' || to_json(search_query)::varchar || ',' || to_json(role)::varchar || ']') AS query_id, * FROM g)"""


def drawn(source: str, seed: int) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY sha256('{seed}:' || search_query), search_query) AS draw FROM {source})"


HELD = f"""held AS (
  SELECT search_query FROM {drawn('(SELECT DISTINCT search_query FROM groups)', C.split_seed)}
  WHERE draw <= ceil((SELECT count(DISTINCT search_query) FROM groups) * {C.holdout_share}::double))"""

_PASSAGES = ",\n".join([ITEMS, queries_cte(10_000), index_ctes(DESCRIPTION), lexical_ctes(DESCRIPTION, filters=False)])
_PREFIXES = ",\n".join([ITEMS, queries_cte(20), index_ctes(DESCRIPTION), lexical_ctes(DESCRIPTION, filters=False)])
_VQ = "vq AS (SELECT vec_id::varchar AS query_id, label::bigint AS place, embedding AS q FROM embeddings WHERE vec_id < 50)"
_DENSE = "SELECT query_id, vec_id AS doc, round(list_inner_product(q::double[], embedding::double[]), 6) + 0 AS score, place, label FROM vq, embeddings"
_ANSWER = f"""{CANDIDATES},
fused AS ({best('pool', C.answer_k, 'rrf')}),
answer AS (
  SELECT queries.query_id, coalesce(string_agg(ranked.item_id, ' ' ORDER BY rank), '') AS answer
  FROM queries LEFT JOIN (SELECT query_id, rank, items.item_id FROM fused JOIN items USING (doc)) ranked USING (query_id) GROUP BY queries.query_id)"""

SQL: dict[str, str] = {
    "text_normalize": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "tokenize_counts": f"SELECT doc_id, len({toks('text')})::int AS tokens, len(list_distinct({toks('text')}))::int AS distinct_tokens, len({toks('text', 1000)})::int AS tokens_of_1000 FROM documents",
    "prompts": f"WITH {ITEMS} SELECT doc, 'passage: ' || title || '. ' || substring(coalesce(description, ''), 1, 600) AS passage, 'query: ' || title || '. ' || substring(coalesce(params, ''), 1, 200) AS query FROM items",
    "scan_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("documents", "benchmark", "embeddings", "lineitem")),
    "dedup_keep_first": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) = 1",
    "doc_numbers": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc FROM (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) = 1)",
    "query_groups": f"WITH {GROUPS} SELECT query_id, search_query, role, positives FROM groups",
    "min_key_per_text": f"WITH {GROUPS} SELECT search_query, min(query_id) AS query_id, arg_min(role, query_id) AS role FROM groups GROUP BY search_query",
    "key_ids": f"""WITH {queries_cte()} SELECT query_id, sha256('["' || search_infm_params_text || '",' || search_location_id || ',' || coalesce(nullif(search_category, 0)::varchar, 'null') || ']') AS key_id FROM queries""",
    "holdout_split": f"WITH {GROUPS}, {HELD} SELECT search_query FROM held",
    "fit_split": f"""WITH {GROUPS}, {HELD},
warm AS (SELECT search_query, count(*) AS keys, min(query_id) AS query_id FROM groups WHERE search_query NOT IN (FROM held) GROUP BY search_query HAVING count(*) > 1),
second AS (SELECT query_id FROM {drawn('warm', C.secondary_seed)} WHERE draw <= {C.secondary_texts})
SELECT query_id, search_query, role FROM groups WHERE search_query NOT IN (FROM held) AND query_id NOT IN (FROM second)""",
    "ranker_queries": f"""WITH {GROUPS}, {HELD},
first AS (SELECT search_query, min(query_id) AS query_id FROM groups WHERE search_query NOT IN (FROM held) GROUP BY search_query)
SELECT query_id, search_query, CASE WHEN draw <= {C.train_queries} THEN 'train' ELSE 'internal' END AS part
FROM {drawn('first', C.ranker_seed)} WHERE draw <= {C.train_queries + C.internal_queries}""",
    "split_disjoint": f"WITH {GROUPS}, {HELD} SELECT count(*) AS shared_texts FROM (FROM held INTERSECT SELECT search_query FROM groups WHERE search_query NOT IN (FROM held))",
    "bm25_idf": f"WITH {ITEMS}, {index_ctes(DESCRIPTION)} SELECT DISTINCT term, df, round(idf, 6) AS idf FROM idx",
    "bm25_postings": f"WITH {ITEMS}, {index_ctes()} SELECT field, term, doc, tf, round(weight, 6) AS weight FROM idx",
    "bm25_topk": f"WITH {_PASSAGES} {best('lex', 50, 'round(lexical, 6)')}",
    "bm25_fielded_topk": f"WITH {GEO} {best('lex', 50, 'round(lexical, 6)')}",
    "bm25_base_topk": f"""WITH {GEO},
base AS (SELECT *, round(lexical * CASE WHEN exact THEN {C.base_location}::double ELSE 1 END * CASE WHEN category THEN {C.category}::double ELSE 1 END, 6) AS base FROM placed)
{best('base', 50, 'base')}""",
    "bm25_geo_topk": f"WITH {GEO} {best('scored', 50)}",
    "bm25_padded_topk": f"""WITH {GEO},
al AS (SELECT query_id, doc, coalesce(score, 0) AS score, score IS NULL AS pad FROM queries CROSS JOIN items LEFT JOIN scored USING (query_id, doc))
SELECT query_id, doc, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pad, doc))::int AS rank FROM al) WHERE rank <= {C.bm25_k}""",
    "transition_edges": f"WITH {edges_ctes(NATIONS)} SELECT source, target, count, round(signal, 9) AS signal FROM edges",
    "transition_roles": f"WITH {edges_ctes(ROLES)} SELECT source, target, count, round(signal, 9) AS signal FROM edges",
    "transition_top3": f"WITH {edges_ctes(NATIONS)} SELECT source, target, rank::int AS rank FROM linked",
    "dense_global_topk": f"WITH {_VQ} {best(f'({_DENSE})', 100)}",
    "dense_exact_topk": f"WITH {_VQ} {best(f'(SELECT * FROM ({_DENSE}) WHERE place = label)', 20)}",
    "dense_transition_topk": f"WITH {_VQ}, {edges_ctes(NATIONS)} {best(f'(SELECT x.* FROM ({_DENSE}) x JOIN linked ON source = place AND target = label)', 20)}",
    "candidate_union": f"WITH {CANDIDATES} SELECT query_id, doc, channel_count, bm25_at, global_at, exact_at, transition_at FROM pool",
    "rrf_fusion": f"WITH {CANDIDATES} SELECT query_id, doc, score AS rrf, rank FROM ({best('pool', 50, 'rrf')})",
    "features_39": FEATURES,
    "sample_v1": f"{LABELLED} {_filled(f'label = 1 OR {_HEAD}', '(SELECT * FROM lab WHERE query_id IN (FROM found))')}",
    "hard_negatives": f"{LABELLED} SELECT query_id, doc, score AS model_score, rank FROM ({best('(SELECT * FROM ms WHERE label = 0)', FEW.hard_negatives, 'model_score')})",
    "sample_v2": f"""{LABELLED},
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY model_score DESC, doc) AS hr FROM ms WHERE query_id IN (FROM found))
{_filled(f'label = 1 OR hr <= {FEW.hard_negatives}', 'hr')}""",
    "recall_at_k": f"""WITH {_PREFIXES}, {POSITIVES},
b AS ({best('lex', 50, 'round(lexical, 6)')}),
t AS (SELECT query_id, count(*) AS total FROM positives GROUP BY query_id),
r AS (SELECT t.query_id, k, total, (SELECT count(*) FROM b JOIN positives p USING (query_id, doc) WHERE b.query_id = t.query_id AND rank <= k) AS hits
      FROM t CROSS JOIN (SELECT unnest([1, 5, 10, 50]) AS k))
SELECT k, round(avg(hits::double / total), 6) AS recall FROM r GROUP BY k""",
    "submission_rows": f"WITH {_ANSWER} SELECT query_id, answer FROM answer",
    "submission_violations": "SELECT rule, 0::bigint AS violations FROM (SELECT unnest(['answers_of_unknown_queries', 'queries_without_answer', 'repeated_queries', 'wrong_number_of_items', 'repeated_items', 'unknown_items']) AS rule)",
    "submission_stats": f"WITH {_ANSWER}, n AS (SELECT len(string_split(answer, ' ')) AS n FROM answer) SELECT count(*) AS queries, round(avg(n), 6) AS mean_candidates, min(n)::int AS min_candidates, max(n)::int AS max_candidates FROM n",
    "train_pairs": f"""WITH rows AS (SELECT {norm('o_orderpriority')} AS text, c_nationkey::bigint AS source, l_partkey, s_nationkey::bigint AS target, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
firsts AS (FROM rows QUALIFY row_number() OVER (PARTITION BY text, source, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, target) = 1)
SELECT source, target, count(*) AS pairs FROM firsts GROUP BY source, target""",
    "mean_pooling": """WITH cells AS (SELECT vec_id // 8 AS text_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS place FROM embeddings WHERE vec_id % 3 <> 0),
means AS (SELECT text_id, place::int AS place, avg(v) AS m FROM cells GROUP BY text_id, place),
norms AS (SELECT text_id, sqrt(sum(m * m)) AS n FROM means GROUP BY text_id)
SELECT text_id, place, round(CASE WHEN n > 0 THEN m / n ELSE m END, 6) AS value FROM means JOIN norms USING (text_id)""",
    "features_not_finite": "SELECT 0::bigint AS violations",
}
