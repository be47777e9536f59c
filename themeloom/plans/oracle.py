"""SQL for the queries of :mod:`themeloom.plans.queries`."""

from __future__ import annotations

_STOP = ", ".join(f"'{w}'" for w in ("the", "of", "and", "with", "for", "by", "an", "in", "de", "la", "les", "und"))
_TOK = """
wl AS (SELECT doc_id, source AS corpus, ts, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents),
tok AS (SELECT doc_id, corpus, unnest(l) AS term, unnest(range(len(l))) AS pos FROM wl)"""
_TF = f"{_TOK}, dtf AS (SELECT doc_id, corpus, term, count(*) AS n FROM tok GROUP BY doc_id, corpus, term)"
_PRUNED = f"""{_TF},
vocab_p AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM dtf GROUP BY term HAVING sum(n) > 2 AND sum(n) < 10000000),
ptf AS (SELECT d.doc_id, d.corpus, d.term, d.n, CAST(d.doc_id % 5 AS INTEGER) AS k FROM dtf d JOIN vocab_p USING (term))"""
_LEN = f"{_TOK}, lens AS (SELECT doc_id, corpus, ts, CAST(len(l) AS BIGINT) AS len FROM wl)"
_MONTHS = "m AS (SELECT doc_id, source AS corpus, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS bucket FROM documents WHERE ts IS NOT NULL)"
_TOPIC = f"{_TOK}, tt AS (SELECT doc_id, corpus, term, pos, CAST((doc_id + pos) % 5 AS INTEGER) AS k FROM tok)"
_TIME_CELLS = f"""
WITH {_LEN}, mm AS (SELECT *, year(ts) * 12 + month(ts) - 1 AS bucket FROM lens WHERE ts IS NOT NULL),
ends AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM mm), spine AS (SELECT lo, unnest(range(lo, hi + 1)) AS bucket FROM ends),
grid AS (SELECT CAST(s.bucket - s.lo AS INTEGER) AS time_idx, s.bucket, c.corpus FROM spine s, (SELECT DISTINCT corpus FROM mm) c),
cells AS (SELECT corpus, bucket, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, avg(len) AS avg_len FROM mm GROUP BY corpus, bucket),
full_grid AS (SELECT g.time_idx, g.corpus, coalesce(c.docs, 0) AS docs, coalesce(c.tokens, 0) AS tokens, round(c.avg_len, 6) AS avg_len FROM grid g LEFT JOIN cells c ON c.corpus = g.corpus AND c.bucket = g.bucket)
"""
_VEC = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_CELLS = f"{_VEC}, cells AS (SELECT vec_id, unnest(e) AS v, unnest(range(len(e))) AS col FROM v)"
_MOVES = "moves AS (SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS old, CAST(doc_id % 5 AS INTEGER) AS new FROM documents)"


def _top(source: str, keys: str, n: str, top: int) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {n} DESC, term) AS INTEGER) AS rank FROM {source}) WHERE rank <= {top}"


def _transition(row: str, column: str, live: int) -> str:
    return f"""WITH {_MOVES}, f AS (SELECT {row}, {column}, count(*) AS size FROM moves GROUP BY {row}, {column}),
    s AS (SELECT *, size / sum(size) OVER (PARTITION BY {row}) AS share FROM f), live AS (SELECT CAST(unnest(range({live})) AS INTEGER) AS k)
    SELECT coalesce(s.{row}, l.k) AS {row}, coalesce(s.{column}, l.k) AS {column}, coalesce(size, 0) AS size, round(coalesce(share, 1.0), 6) AS share, l.k IS NOT NULL AS source_alive
    FROM s FULL JOIN live l ON l.k = s.{row}"""


_SCORES = f"""
WITH {_PRUNED}, big AS (SELECT count(*) * 0.5 AS b FROM vocab_p),
assign AS (SELECT doc_id, source AS corpus, CAST(doc_id % 5 AS INTEGER) AS k FROM documents),
dl AS (SELECT doc_id, sum(n) AS len, sum(lgamma(0.5 + n) - lgamma(0.5)) AS empty_terms FROM ptf GROUP BY doc_id),
ds AS (SELECT a.doc_id, a.corpus, a.k AS z, coalesce(len, 0) AS len, coalesce(empty_terms, 0) AS empty_terms FROM assign a LEFT JOIN dl ON dl.doc_id = a.doc_id),
nkw AS (SELECT k, term, sum(n) AS n_kw FROM ptf GROUP BY k, term), nk AS (SELECT k, sum(n_kw) AS n_k FROM nkw GROUP BY k),
sz AS (SELECT k, count(*) AS docs FROM assign GROUP BY k), njk AS (SELECT corpus, k, count(*) AS n_jk FROM assign GROUP BY corpus, k)"""


def _marginal(own: int) -> str:
    return f"""{_SCORES},
g AS (SELECT p.doc_id, c.k, sum(CASE WHEN c.n_kw - CASE WHEN c.k = p.k THEN p.n ELSE 0 END * {own} > 0
        THEN lgamma(0.5 + c.n_kw - CASE WHEN c.k = p.k THEN p.n ELSE 0 END * {own} + p.n) - lgamma(0.5 + c.n_kw - CASE WHEN c.k = p.k THEN p.n ELSE 0 END * {own}) - lgamma(0.5 + p.n) + lgamma(0.5) ELSE 0 END) AS gain
      FROM ptf p JOIN nkw c ON c.term = p.term GROUP BY p.doc_id, c.k),
sc AS (SELECT d.doc_id, s.k, d.z, d.len, coalesce(j.n_jk, 0) - CASE WHEN s.k = d.z THEN {own} ELSE 0 END AS n_jk, s.docs - CASE WHEN s.k = d.z THEN {own} ELSE 0 END AS docs_left, d.empty_terms,
        CASE WHEN d.len = 0 THEN 0 ELSE d.empty_terms + coalesce(g.gain, 0) - lgamma(b + nk.n_k - CASE WHEN s.k = d.z THEN {own} ELSE 0 END * d.len + d.len) + lgamma(b + nk.n_k - CASE WHEN s.k = d.z THEN {own} ELSE 0 END * d.len) END AS logmarg,
        CASE WHEN d.len = 0 THEN 0 ELSE d.empty_terms - lgamma(b + d.len) + lgamma(b) END AS logmarg_new
      FROM ds d, big, sz s LEFT JOIN nk ON nk.k = s.k LEFT JOIN g ON g.doc_id = d.doc_id AND g.k = s.k LEFT JOIN njk j ON j.corpus = d.corpus AND j.k = s.k),
kept AS (SELECT * FROM sc WHERE docs_left > 0)
"""


def _best(own: int, new: bool) -> str:
    more = "UNION ALL SELECT DISTINCT doc_id, -1 AS k, ln(0.25) + logmarg_new AS score, 1000 AS o FROM sc" if new else ""
    return f"""{_marginal(own)}, opts AS (SELECT doc_id, k, ln(n_jk + 0.15) + logmarg AS score, k AS o FROM kept {more}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS rn FROM opts) SELECT doc_id, CAST(k AS INTEGER) AS k FROM r WHERE rn = 1"""


_KL = f"""
WITH {_PRUNED}, c AS (SELECT corpus, term, sum(n) AS n FROM ptf GROUP BY corpus, term), p AS (SELECT corpus, term, n / sum(n) OVER (PARTITION BY corpus) AS p FROM c),
a AS (SELECT term, sum(n) AS n FROM ptf GROUP BY term), q AS (SELECT term, n / (SELECT sum(n) FROM a) AS q FROM a),
grid AS (SELECT s.corpus, q.term, q.q, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT corpus FROM ptf) s, q LEFT JOIN p ON p.term = q.term AND p.corpus = s.corpus)
"""
_P, _Q = "(p + 1e-4)", "(q + 1e-4)"

ORACLE = {
    "tokenize_counts": f"WITH {_TOK} SELECT term, count(*) AS n FROM tok GROUP BY term",
    "token_positions": f"WITH {_TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tok",
    "stopword_filter": f"WITH {_TOK} SELECT doc_id, count(*) AS n FROM tok WHERE term NOT IN ({_STOP}) GROUP BY doc_id",
    "vocab_pruned": f"WITH {_PRUNED} SELECT row_number() OVER (ORDER BY term) - 1 AS w, term, tf, df FROM vocab_p",
    "term_df_idf": f"WITH {_TF} SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM dtf GROUP BY term",
    "doc_tf": f"WITH {_PRUNED} SELECT doc_id, term, n FROM ptf",
    "doc_feature_sequence": f"WITH {_PRUNED}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS w FROM vocab_p) SELECT doc_id, string_agg(CAST(w AS VARCHAR), ' ' ORDER BY pos) AS seq FROM tok JOIN ids USING (term) GROUP BY doc_id",
    "corpus_stats": f"WITH {_LEN} SELECT corpus, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, round(avg(len), 6) AS avg_len FROM lens GROUP BY corpus",
    "corpus_stats_rollup": f"WITH {_LEN} SELECT corpus, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, round(avg(len), 6) AS avg_len, CAST(grouping(corpus) AS INTEGER) AS is_total FROM lens GROUP BY ROLLUP(corpus)",
    "corpus_messages": f"WITH {_LEN} SELECT corpus, corpus || ': ' || count(*) || ' documents, ' || CAST(sum(len) AS BIGINT) || ' tokens, ' || CAST(floor(avg(len)) AS BIGINT) || '.00 on average' AS message FROM lens GROUP BY corpus",
    "time_corpus_stats": f"{_TIME_CELLS} SELECT * FROM full_grid",
    "empty_cells": f"{_TIME_CELLS} SELECT time_idx, corpus FROM full_grid WHERE docs = 0",
    "month_spine": f"WITH {_MONTHS}, e AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM m), s AS (SELECT lo, unnest(range(lo, hi + 1)) AS b FROM e) SELECT CAST(b - lo AS INTEGER) AS time_idx, lpad(CAST(b // 12 AS VARCHAR), 4, '0') || lpad(CAST(b % 12 + 1 AS VARCHAR), 2, '0') AS label FROM s",
    "year_spine": "WITH e AS (SELECT min(year(ts)) AS lo, max(year(ts)) AS hi FROM documents), s AS (SELECT lo, unnest(range(lo, hi + 1)) AS b FROM e) SELECT CAST(b - lo AS INTEGER) AS time_idx, CAST(b AS VARCHAR) AS label FROM s",
    "corpus_names": "SELECT d.doc_id, coalesce(m.source, 'Unknown name.') AS name FROM documents d LEFT JOIN (SELECT source FROM mix_targets WHERE source < 'm') m ON m.source = d.source",
    "cumulative_cluster_sizes": f"WITH {_MONTHS}, c AS (SELECT corpus, CAST(doc_id % 5 AS INTEGER) AS k, bucket, count(*) AS n FROM m GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY corpus, k ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_upto FROM c",
    "search_term": r"SELECT DISTINCT rec_id FROM bib_records WHERE list_contains(regexp_extract_all(lower(abstract), '[a-z0-9_]+'), 'newspapers')",
    "search_boolean": r"SELECT DISTINCT rec_id FROM bib_records WHERE coalesce(list_contains(regexp_extract_all(lower(abstract), '[a-z0-9_]+'), 'newspapers'), false) AND NOT coalesce(list_contains(regexp_extract_all(lower(title), '[a-z0-9_]+'), 'dynamic'), false) AND NOT coalesce(list_contains(regexp_extract_all(lower(year), '[a-z0-9_]+'), '2004'), false)",
    "search_all": "SELECT DISTINCT rec_id FROM bib_records",
    "sample_fraction_hash": "SELECT doc_id FROM documents ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM documents)",
    "kfold_mod": "SELECT doc_id, CAST(doc_id % 10 AS INTEGER) AS fold FROM documents",
    "parse_labelled_records": r"""SELECT rec_id, trim(max(coalesce(regexp_replace(year, '[\r\n]+', ' ', 'g'), ''))) AS year, trim(max(coalesce(regexp_replace(title, '[\r\n]+', ' ', 'g'), ''))) AS title, max(uri) AS uri, 'vis' AS conf_name FROM bib_records GROUP BY rec_id""",
    "cluster_stats": f"WITH {_PRUNED} SELECT s.k, s.size, t.tokens FROM (SELECT CAST(doc_id % 5 AS INTEGER) AS k, count(*) AS size FROM documents GROUP BY 1) s JOIN (SELECT k, CAST(sum(n) AS BIGINT) AS tokens FROM ptf GROUP BY k) t ON t.k = s.k",
    "cluster_members": "SELECT CAST(doc_id % 5 AS INTEGER) AS k, doc_id FROM documents",
    "cluster_keywords": f"WITH {_PRUNED}, c AS (SELECT k, term, CAST(sum(n) AS BIGINT) AS n_kw FROM ptf GROUP BY k, term) {_top('c', 'k', 'n_kw', 10)}",
    "cluster_keywords_text": f"WITH {_PRUNED}, c AS (SELECT k, term, CAST(sum(n) AS BIGINT) AS n_kw FROM ptf GROUP BY k, term), r AS ({_top('c', 'k', 'n_kw', 10)}) SELECT k, string_agg(term || '(' || n_kw || '),', ' ' ORDER BY rank) AS keywords FROM r GROUP BY k",
    "cluster_keywords_by_corpus": f"WITH {_PRUNED}, c AS (SELECT corpus, k, term, CAST(sum(n) AS BIGINT) AS n_kw FROM ptf GROUP BY corpus, k, term) {_top('c', 'corpus, k', 'n_kw', 10)}",
    "cluster_rollup": f"WITH {_PRUNED} SELECT k, corpus, CAST(sum(n) AS BIGINT) AS tokens, CAST(grouping(k) * 2 + grouping(corpus) AS INTEGER) AS level FROM ptf GROUP BY ROLLUP(k, corpus)",
    "topic_stats": f"WITH {_TOPIC} SELECT corpus, k, count(*) AS tokens, count(DISTINCT term) AS terms FROM tt GROUP BY corpus, k",
    "topic_keywords": f"WITH {_TOPIC}, c AS (SELECT k, term, count(*) AS n_kw FROM tt GROUP BY k, term) {_top('c', 'k', 'n_kw', 10)}",
    "doc_topic_matrix": f"WITH {_TOPIC} SELECT doc_id, k, count(*) AS n FROM tt GROUP BY doc_id, k",
    "topics_per_doc": f"WITH {_TOPIC} SELECT doc_id, count(DISTINCT k) AS topics FROM tt GROUP BY doc_id",
    "split_matrix": _transition("old", "new", 8),
    "merge_matrix": _transition("new", "old", 4),
    "split_keywords": f"WITH {_PRUNED}, {_MOVES}, c AS (SELECT old, new, term, CAST(sum(n) AS BIGINT) AS n FROM moves JOIN ptf USING (doc_id) GROUP BY old, new, term) {_top('c', 'old, new', 'n', 3)}",
    "timeslice_summary": f"""WITH {_PRUNED}, y AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS k, year(ts) - (SELECT min(year(ts)) FROM documents) AS t FROM documents WHERE ts IS NOT NULL),
      here AS (SELECT * FROM y WHERE t = 1), sz AS (SELECT k, count(*) AS size FROM here GROUP BY k), c AS (SELECT here.k, term, CAST(sum(n) AS BIGINT) AS n FROM here JOIN ptf USING (doc_id) GROUP BY here.k, term), r AS ({_top('c', 'k', 'n', 3)}),
      live AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS k) SELECT l.k, coalesce(size, 0) AS size, term, n, rank FROM live l LEFT JOIN sz ON sz.k = l.k LEFT JOIN r ON r.k = l.k""",
    "vec_add": f"{_CELLS} SELECT vec_id, round(sum(3 * v), 4) AS s FROM cells GROUP BY vec_id",
    "vec_dot": f"{_VEC} SELECT vec_id, round(list_dot_product(e, list_reverse(e)), 6) AS dot FROM v",
    "vec_norm2": f"{_CELLS} SELECT vec_id, round(sum(v * v), 5) AS norm2 FROM cells GROUP BY vec_id",
    "vec_minmax": f"{_VEC}, x AS (SELECT vec_id, e, list_aggregate(e, 'max') AS hi, list_aggregate(e, 'min') AS lo FROM v) SELECT vec_id, CAST(list_position(e, hi) - 1 AS INTEGER) AS max_at, CAST(list_position(e, lo) - 1 AS INTEGER) AS min_at, round(hi, 6) AS max_v, round(lo, 6) AS min_v FROM x",
    "vec_topk": f"{_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, col) AS rn FROM cells) SELECT vec_id, string_agg(CAST(col AS VARCHAR), ',' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY vec_id",
    "matrix_row_col_stats": f"{_CELLS} SELECT 'row' AS axis, vec_id AS i, round(sum(v), 4) AS total, round(max(v), 6) AS top, round(min(v), 6) AS low FROM cells GROUP BY vec_id UNION ALL SELECT 'col', col, round(sum(v), 4), round(max(v), 6), round(min(v), 6) FROM cells GROUP BY col",
    "sparse_from_dense": f"{_CELLS} SELECT vec_id, CAST(count(*) AS INTEGER) AS dim, coalesce(string_agg(CASE WHEN v > 0.1 THEN CAST(col AS VARCHAR) END, ',' ORDER BY col), '') AS idx FROM cells GROUP BY vec_id",
    "sparse_dense_dot": f"{_CELLS} SELECT vec_id, round(sum(CASE WHEN v > 0.1 THEN v * v ELSE 0 END), 6) AS dot FROM cells GROUP BY vec_id",
    "unique_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "positions_of_values": "SELECT l.label, e.vec_id FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS label) l LEFT JOIN embeddings e ON e.label = l.label",
    "mean_std": f"{_CELLS} SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM cells GROUP BY vec_id",
    "normalize_tf": f"WITH {_PRUNED} SELECT doc_id, term, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS p FROM ptf",
    "kl_corpora": f"{_KL} SELECT corpus, round(sum({_P} * ln({_P} / {_Q})), 4) AS kl FROM grid GROUP BY corpus",
    "sym_kl_corpora": f"{_KL} SELECT corpus, round(sum({_P} * ln({_P} / {_Q}) + {_Q} * ln({_Q} / {_P})) / 2, 4) AS sym_kl FROM grid GROUP BY corpus",
    "posterior_loglik": f"{_CELLS}, x AS (SELECT vec_id, col, exp(100 * v - max(100 * v) OVER (PARTITION BY vec_id)) AS u FROM cells WHERE col < 5) SELECT vec_id, CAST(col AS INTEGER) AS k, round(u / sum(u) OVER (PARTITION BY vec_id), 6) AS p FROM x",
    "sumlog_range": f"WITH {_LEN} SELECT doc_id, CASE WHEN len = 0 THEN 0 ELSE round(lgamma(0.5 + len) - lgamma(0.5), 4) END AS s FROM lens",
    "doc_log_marginal": f"{_marginal(1)} SELECT doc_id, k, round(logmarg, 4) AS logmarg FROM kept",
    "doc_empty_marginal": f"{_SCORES} SELECT doc_id, CASE WHEN len = 0 THEN 0 ELSE round(empty_terms - lgamma(b + len) + lgamma(b), 4) END AS logmarg FROM ds, big",
    "cluster_loglik": f"{_marginal(0)} SELECT doc_id, k, round(logmarg, 4) AS logmarg FROM sc WHERE k = z",
    "token_loglik": f"WITH {_TOPIC}, a AS (SELECT k, term, count(*) AS n_kw FROM tt GROUP BY k, term), s AS (SELECT k, count(*) AS n_k FROM tt GROUP BY k), w AS (SELECT count(DISTINCT term) AS w FROM tt) SELECT doc_id, round(sum(ln((n_kw + 0.5) / (n_k + 0.5 * w))), 4) AS loglik FROM tt JOIN a USING (k, term) JOIN s USING (k), w GROUP BY doc_id",
    "map_reassign": _best(1, False),
    "map_reassign_with_new": _best(1, True),
    "predict_cluster": _best(0, False),
    "predict_token_probs": f"WITH {_TOPIC}, a AS (SELECT k, term, count(*) AS n_kw FROM tt GROUP BY k, term), s AS (SELECT k, count(*) AS n_k FROM tt GROUP BY k), t AS (SELECT DISTINCT term FROM tt), raw AS (SELECT t.term, s.k, 0.15 * (coalesce(n_kw, 0) + 0.5) / (n_k + 0.5 * (SELECT count(*) FROM t)) AS r FROM t, s LEFT JOIN a ON a.k = s.k AND a.term = t.term) SELECT term, k, round(r / sum(r) OVER (PARTITION BY term), 6) AS p FROM raw",
}
