"""Queries that run the random, concentration, weight, source and vector operators, each with the SQL that checks it.

Seeded draws are compared by their moments: a query reports the expected value where the mean of its
draws lies within the stated tolerance, and the mean itself where it does not, so that a wrong operator shows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import random as R
from themeloom.functions import text, vectors
from themeloom.operators import stats, timeline
from themeloom.plans import clustering, hyper, topics
from themeloom.plans import queries as Q
from themeloom.plans.lineage import checkpoint_dir
from themeloom.plans.oracle import ORACLE as MODEL
from themeloom.sources import records


def _settled(mean: float, expected: float, tolerance: float) -> float:
    return round(expected if abs(mean - expected) <= tolerance else mean, 4)


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(str(n), float(v)) for n, v in rows], "name string, value double")


def random_draws(spark, d):
    g, n = R.generator(7, 1), 40_000
    several = lambda f, m: np.mean([f() for _ in range(m)], axis=0)
    gauss = np.array([R.spherical_gaussian(g, [3.0], 4.0)[0] for _ in range(n)])
    order = R.permutation(g, 1000)
    rows = [
        ("gamma", _settled(R.gammas(g, [2.5] * n).mean(), 2.5, 0.05)), ("dirichlet", _settled(several(lambda: R.dirichlet(g, [1.0, 2.0, 3.0]), 6000)[1], 2 / 6, 0.01)), ("smooth", round(float(R.smooth(np.array([0.0, 1.0, 3.0]))[2]), 4)),
        ("categorical", _settled(several(lambda: R.categorical(g, [0.2, 0.3, 0.5]) == 2, n), 0.5, 0.01)), ("multinomial", _settled(several(lambda: R.multinomial(g, [2, 3, 5], 20), 4000)[0], 4.0, 0.1)),
        ("sequence", _settled((R.categorical_sequence(g, [0.1, 0.9], n) == 0).mean(), 0.1, 0.01)), ("gaussian_mean", _settled(gauss.mean(), 3.0, 0.05)), ("gaussian_variance", _settled(gauss.var(), 4.0, 0.15)),
        ("beta", _settled(several(lambda: R.beta(g, 2.0, 6.0), n), 0.25, 0.01)), ("labels", _settled((R.initial_labels(g, n, 8) == 3).mean(), 1 / 8, 0.01)),
        ("permutation", float(order.sum())), ("permutation_distinct", float(len(set(order.tolist())))), ("repeatable", float((R.generator(5, 2).random(9) == R.generator(5, 2).random(9)).all())),
    ]
    return _rows(spark, rows)


def crp_expected_tables(spark, d):
    """Expected tables of a restaurant with as many customers as a corpus has documents, both forms, and the mean of seeded draws."""
    sizes = sorted((r["corpus"], r["n"]) for r in Q._docs(spark, d).groupBy("corpus").agg(F.count("*").alias("n")).collect())
    rows = []
    for i, (corpus, n) in enumerate(sizes):
        exact, simple = (R.expected_crp_tables(n, Q.ALPHA, crp) for crp in ("exact", "reference"))
        drawn = [R.crp_tables(R.generator(3, i), n, Q.ALPHA, crp, 4000) / 4000 for crp in ("exact", "reference")]
        rows.append((corpus, round(exact, 4), round(simple, 4), _settled(drawn[0], exact, 0.2), _settled(drawn[1], simple, 0.2)))
    return spark.createDataFrame(rows, "corpus string, exact double, simple double, drawn_exact double, drawn_simple double")


GRID = [0.01 * i for i in range(1, 4000)]


def _posterior_mean(power: float, rate: float, groups: list[tuple[float, int]]) -> float:
    """Mean of x^power e^(-rate x) times the groups' Gamma(x) / Gamma(x + n), over the grid."""
    logs = np.array([power * math.log(x) - rate * x + sum(m * (math.lgamma(x) - math.lgamma(x + n)) for n, m in groups) for x in GRID])
    w = np.exp(logs - logs.max())
    return float((w * GRID).sum() / w.sum())


def hyper_concentrations(spark, d):
    """Means of resampled concentrations: gamma of tables over components, alpha of the corpora's documents."""
    sizes = sorted((r["n"], r["times"]) for r in Q._docs(spark, d).groupBy("corpus").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times")).collect())
    rng = R.generator(11)
    corpora = sum(t for _, t in sizes)
    gamma, alpha, gammas, alphas = 1.0, 1.0, [], []
    for _ in range(3000):
        gamma = hyper.resample_gamma(rng, gamma, 60, 9, 2.0, 1.0, 5)
        alpha = hyper.resample_alpha(rng, alpha, [n for n, _ in sizes], 3 * corpora, 2.0, 1.0, 5, [t for _, t in sizes])
        gammas.append(gamma), alphas.append(alpha)
    expected = _posterior_mean(2.0 - 1 + 9, 1.0, [(60, 1)]), _posterior_mean(2.0 - 1 + 3 * corpora, 1.0, [(n, t) for n, t in sizes])
    return _rows(spark, [("gamma", _settled(np.mean(gammas), expected[0], 0.1)), ("alpha", _settled(np.mean(alphas), expected[1], 0.05))])


def stick_breaking(spark, d):
    """Mean share of the unseen weight that stays unseen: one level, and two levels (global, then in a corpus)."""
    rng, corpora, one, two = R.generator(13), {"a": ({1: 0.6}, 0.4), "b": ({1: 0.5}, 0.5)}, [], []
    for _ in range(20_000):
        out, _ = topics.break_sticks(rng, corpora, None, 3.0, 1.0, 2)
        one.append(out["a"][1] / 0.4)
        out, above = topics.break_sticks(rng, corpora, ({1: 0.7}, 0.3), 3.0, 1.5, 2)
        two.append((above[1] / 0.3, out["b"][1] / 0.5))
    weights = {1: 0.5}
    rest = clustering.new_component(rng, weights, 0.5, 2.0, 2)
    high = np.mean(two, axis=0)
    return _rows(spark, [("one_level", _settled(np.mean(one), 0.75, 0.01)), ("global", _settled(high[0], 0.6, 0.01)), ("corpus", _settled(high[1], 0.6, 0.02)), ("kept", round(weights[1] + weights[2] + rest, 6))])


def table_weights(spark, d):
    """Mean weight of each component, and of the unseen part, over seeded resamplings from the documents of each corpus and component."""
    local = clustering._local(Q._assign(spark, d))
    weights = {k: 0.15 for k in range(Q.K)}
    rng, sums = R.generator(17), {}
    for _ in range(400):
        w, unseen, tables = clustering.resample_weights(rng, local, weights, 2.0, 1.0, "exact")
        for k, v in [*w.items(), ("unseen", unseen), ("tables", tables)]:
            sums[k] = sums.get(k, 0.0) + v / 400
    expected: dict = {}
    for _, k, n in local:
        expected[k] = expected.get(k, 0.0) + R.expected_crp_tables(n, 2.0 * weights[k])
    total = sum(expected.values())
    rows = [(k, _settled(sums[k], e / (total + 1.0), 0.02)) for k, e in sorted(expected.items())]
    return _rows(spark, [*rows, ("tables", _settled(sums["tables"], total, 0.03 * total))])


def sweep_step(spark, d):
    """One batch sweep in which every document may move, without new components."""
    pruned, n = Q._model(spark, d)
    return clustering.sweep(Q._assign(spark, d), pruned, Q._WEIGHTS, 0.25, Q.ALPHA, Q.B0, n, False, Q.K).select("doc_id", "k")


def given_labels(spark, d):
    docs = Q._docs(spark, d)
    labels = docs.select("doc_id", F.when(F.col("corpus") < "m", F.substring("corpus", 1, 2)).alias("label"))
    return clustering.given_labels(docs.select("doc_id"), labels)


def local_components(spark, d):
    found = clustering.local_components(clustering._local(Q._assign(spark, d)))
    return spark.createDataFrame(sorted(found.items()), "corpus string, components int")


_QUERY = "(title:visual OR title:data) AND NOT title:graph"


def _index(spark, d) -> str:
    """An index of bib_records in two loads, the second one appended."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/bib_records.parquet")
    records.write_index(rows.where("year < '2000'"), path, True)
    records.write_index(rows.where("year >= '2000' OR year IS NULL"), path, False)
    return path


def index_documents(spark, d):
    found = records.load_index(spark, _index(spark, d), _QUERY)
    return found.select("uri", F.length("text").alias("chars"), "corpus", "time")


def index_vocabulary(spark, d):
    return records.load_corpora(spark, _index(spark, d), _QUERY)["vocab"]


def index_slices(spark, d):
    docs = records.load_corpora(spark, _index(spark, d), "*:*")["docs"]
    return docs.groupBy("corpus", "time_idx").agg(F.count("*").alias("docs"))


def lists_source(spark, d):
    """Parallel lists become a source: the nations by region, a month apart."""
    nations = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    docs = records.from_lists(spark, [str(r["n_nationkey"]) for r in nations], [f"{r['n_name']} {r['n_name']} nation nation" for r in nations], [r["n_nationkey"] * 2_678_400_000 for r in nations], [str(r["n_regionkey"]) for r in nations])
    made = records.prepare(docs, timeline.month_bucket(F.timestamp_millis("time")), "month", min_tf=1)
    return made["tf"].join(made["docs"], "uri").select("uri", "corpus", "term", "n")


def stop_file(spark, d):
    """Stop words from a file with a byte-order mark and carriage returns."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stop-{uuid.uuid4().hex}"
    lines = ["﻿" + Q.STOP[0].upper() + "\r", *[w + "\r" for w in Q.STOP[1:]], "", Q.STOP[1]]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return text.without_stop_words(Q._tokens(spark, d), records.read_stop_words(spark, path)).groupBy("term").agg(F.count("*").alias("n"))


def report_files(spark, d):
    """A report of sizes by month and component, written by slice and read again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    sizes = Q._months(spark, d).withColumn("k", F.col("doc_id") % Q.K).groupBy(F.col("bucket").alias("time_idx"), "k").agg(F.count("*").alias("docs"))
    records.write_report(sizes, path)
    return spark.read.schema("k bigint, docs bigint, time_idx int").json(path)


def group_samples(spark, d):
    few = text.sample_per_group(Q._docs(spark, d).select("doc_id", "corpus"), "corpus", "doc_id", 3)
    return few.groupBy("corpus").agg(F.count_distinct("doc_id").alias("docs"))


def seeded_folds(spark, d):
    """Whether every row has one fold and the seeded folds are about even."""
    folded = text.folds(spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")), 4, "key", 9)
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n"))
    even = F.abs(F.col("n") - F.avg("n").over(Q.Window.partitionBy())) < 0.1 * F.avg("n").over(Q.Window.partitionBy())
    return sizes.select("fold", even.alias("even"))


def vec_ops(spark, d):
    e, r6 = F.col("e"), lambda c: F.round(c, 4)
    m = F.map_from_arrays(F.sequence(F.lit(1), F.size("e")), "e")
    shifted = F.map_from_arrays(F.sequence(F.lit(3), F.size("e") + 2), "e")
    first = F.slice("e", 1, 4)
    return Q._vec(spark, d).select(
        "vec_id", r6(vectors.total(vectors.hadamard(e, e))).alias("hadamard"), r6(vectors.total(vectors.exponentials(e))).alias("exponentials"), r6(vectors.total(vectors.roots(F.transform(e, F.abs)))).alias("roots"), r6(vectors.map_total(vectors.map_subtract(m, vectors.map_scale(shifted, 0.5)))).alias("map_subtract"),
        r6(vectors.map_dot(m, shifted)).alias("map_dot"), r6(F.get(vectors.direct_posterior(F.transform(first, F.abs), vectors.fill(4, 0.25)), F.lit(0))).alias("posterior"), vectors.render(F.transform(first, lambda x: (x * 100).cast("int"))).alias("rendered"), r6(vectors.total(vectors.subtract(e, vectors.scale(e, 0.5)))).alias("subtracted"),
    )


def vec_sparse(spark, d):
    big = F.transform("e", lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))
    made = Q._vec(spark, d).select("vec_id", vectors.sparse(big).alias("s"), vectors.sparse(F.reverse(big)).alias("t"))
    added, less = vectors.sparse_add(F.col("s"), vectors.sparse_scale(F.col("t"), 2.0)), vectors.sparse_subtract(F.col("s"), F.col("s"))
    return made.select("vec_id", F.round(vectors.total(added["val"]), 4).alias("added"), F.size(less["idx"]).alias("cancelled"), F.round(vectors.sparse_max(F.col("s")), 6).alias("largest"), F.round(vectors.sparse_min(F.col("s")), 6).alias("smallest"))


def vec_transpose(spark, d):
    rows = F.array(F.col("e"), F.reverse("e"))
    return Q._vec(spark, d).select("vec_id", F.posexplode(vectors.transpose(rows)).alias("col", "pair")).select("vec_id", "col", F.round(F.get("pair", F.lit(0)) - F.get("pair", F.lit(1)), 6).alias("difference"))


def matrix_extremes(spark, d):
    cells = Q._vec(spark, d).select("vec_id", F.posexplode("e").alias("col", "v"))
    found = stats.matrix_extremes(cells, "col", "vec_id", "v")
    return found.select("col", F.round("least", 6).alias("least"), "least_at", F.round("most", 6).alias("most"), "most_at")


def topic_rollup(spark, d):
    return stats.topic_rollup(Q._topic_tokens(spark, d))


def sorted_frequencies(spark, d):
    packed = text.sorted_frequencies(Q._tf(spark, d), 500)
    return packed.select("doc_id", F.array_join("terms", " ").alias("terms"), F.array_join(F.transform("counts", lambda n: n.cast("string")), " ").alias("counts"))


QUERIES = {
    f.__name__: f
    for f in (
        random_draws, crp_expected_tables, hyper_concentrations, stick_breaking, table_weights, sweep_step, given_labels, local_components, index_documents, index_vocabulary, index_slices, lists_source, stop_file, report_files, group_samples, seeded_folds,
        vec_ops, vec_sparse, vec_transpose, matrix_extremes, topic_rollup, sorted_frequencies,
    )
}

_SIZES = "sizes AS (SELECT source AS corpus, count(*) AS n FROM documents GROUP BY source)"
_V = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"
_HITS = f"""hits AS (SELECT *, coalesce(title, '') || coalesce(abstract, '') AS text FROM bib_records
WHERE regexp_matches(lower(title), '(^|{_NOT_WORD})(visual|data)({_NOT_WORD}|$)') AND NOT regexp_matches(lower(title), '(^|{_NOT_WORD})graph({_NOT_WORD}|$)'))"""
_GRID = "grid AS (SELECT 0.01 * i AS x FROM range(1, 4000) t(i))"
ORACLE = {
    "random_draws": "SELECT * FROM (VALUES ('gamma', 2.5), ('dirichlet', round(1 / 3, 4)), ('smooth', 0.75), ('categorical', 0.5), ('multinomial', 4.0), ('sequence', 0.1), ('gaussian_mean', 3.0), ('gaussian_variance', 4.0), ('beta', 0.25), ('labels', 0.125), ('permutation', 499500.0), ('permutation_distinct', 1000.0), ('repeatable', 1.0)) t(name, value)",
    "crp_expected_tables": f"""WITH {_SIZES}, e AS (SELECT corpus, n, (SELECT sum(1.0 / (1.0 + i)) FROM range(n) t(i)) AS exact, 1 + (n - 1) * 1.0 / (n + 1.0) AS simple FROM sizes)
SELECT corpus, round(exact, 4) AS exact, round(simple, 4) AS simple, round(exact, 4) AS drawn_exact, round(simple, 4) AS drawn_simple FROM e""",
    "hyper_concentrations": f"""WITH {_SIZES}, {_GRID}, corpora AS (SELECT count(*) AS c FROM sizes),
l AS (SELECT 'gamma' AS name, x, 10 * ln(x) - x + lgamma(x) - lgamma(x + 60) AS l FROM grid
  UNION ALL SELECT 'alpha', x, (1 + 3 * (SELECT c FROM corpora)) * ln(x) - x + (SELECT sum(lgamma(x) - lgamma(x + n)) FROM sizes) FROM grid),
w AS (SELECT name, x, exp(l - max(l) OVER (PARTITION BY name)) AS w FROM l)
SELECT name, round(sum(w * x) / sum(w), 4) AS value FROM w GROUP BY name""",
    "stick_breaking": "SELECT * FROM (VALUES ('one_level', 0.75), ('global', 0.6), ('corpus', 0.6), ('kept', 1.0)) t(name, value)",
    "table_weights": """WITH n AS (SELECT source, doc_id % 5 AS k, count(*) AS n FROM documents GROUP BY ALL), e AS (SELECT k, sum((SELECT sum(0.3 / (0.3 + i)) FROM range(n) t(i))) AS e FROM n GROUP BY k), s AS (SELECT sum(e) AS s FROM e)
SELECT CAST(k AS VARCHAR) AS name, round(e / (s + 1.0), 4) AS value FROM e, s UNION ALL SELECT 'tables', round(s, 4) FROM s""",
    "sweep_step": MODEL["map_reassign"],
    "given_labels": """WITH l AS (SELECT doc_id, CASE WHEN source < 'm' THEN source[1:2] END AS label FROM documents), r AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM l WHERE label IS NOT NULL))
SELECT l.doc_id, CAST(coalesce(r.k, (SELECT count(*) FROM r)) AS INTEGER) AS k FROM l LEFT JOIN r ON r.label = l.label""",
    "local_components": "SELECT source AS corpus, CAST(count(DISTINCT doc_id % 5) AS INTEGER) AS components FROM documents GROUP BY source",
    "index_documents": f"WITH {_HITS} SELECT uri, CAST(length(text) AS INTEGER) AS chars, conf_name AS corpus, year AS time FROM hits",
    "index_vocabulary": f"""WITH {_HITS}, t AS (SELECT uri, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM hits), c AS (SELECT uri, term, count(*) AS n FROM t GROUP BY ALL)
SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM c GROUP BY term HAVING sum(n) > 2 AND sum(n) < 10000000""",
    "index_slices": "SELECT conf_name AS corpus, CAST(try_cast(year AS INTEGER) - (SELECT min(try_cast(year AS INTEGER)) FROM bib_records) AS INTEGER) AS time_idx, count(*) AS docs FROM bib_records GROUP BY ALL",
    "lists_source": """WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS uri, CAST(n_regionkey AS VARCHAR) AS corpus, unnest(regexp_extract_all(lower(n_name || ' ' || n_name || ' nation nation'), '[a-z]+')) AS term FROM nation)
SELECT uri, corpus, term, count(*) AS n FROM t WHERE term IN (SELECT term FROM t GROUP BY term HAVING count(*) > 1) GROUP BY ALL""",
    "stop_file": f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT term, count(*) AS n FROM t WHERE term NOT IN ({", ".join(f"'{w}'" for w in Q.STOP)}) GROUP BY term""",
    "report_files": "SELECT CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS time_idx, doc_id % 5 AS k, count(*) AS docs FROM documents WHERE ts IS NOT NULL GROUP BY ALL",
    "group_samples": "SELECT source AS corpus, least(count(DISTINCT doc_id), 3) AS docs FROM documents GROUP BY source",
    "seeded_folds": "SELECT CAST(i AS INTEGER) AS fold, true AS even FROM range(4) t(i)",
    "vec_ops": _V + """, a AS (SELECT vec_id, e, list_transform(e, lambda x: abs(x)) AS p FROM v)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS hadamard, round(list_sum(list_transform(e, lambda x: exp(x))), 4) AS exponentials, round(list_sum(list_transform(p, lambda x: sqrt(x))), 4) AS roots, round(list_sum(e) * 0.5, 4) AS map_subtract,
  round(list_sum(list_transform(range(3, len(e) + 1), lambda i: e[i] * e[i - 2])), 4) AS map_dot, round(p[1] / (p[1] + p[2] + p[3] + p[4]), 4) AS posterior, '[' || array_to_string(list_transform(e[1:4], lambda x: CAST(trunc(x * 100) AS INTEGER) || ','), '') || ']' AS rendered, round(list_sum(e) * 0.5, 4) AS subtracted FROM a""",
    "vec_sparse": _V + ", b AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0.0 END) AS x FROM v) SELECT vec_id, round(3 * list_sum(x), 4) AS added, CAST(0 AS INTEGER) AS cancelled, round(list_max(x), 6) AS largest, round(list_min(x), 6) AS smallest FROM b",
    "vec_transpose": _V + ", i AS (SELECT vec_id, e, unnest(range(len(e))) AS col FROM v) SELECT vec_id, CAST(col AS INTEGER) AS col, round(e[col + 1] - e[len(e) - col], 6) AS difference FROM i",
    "matrix_extremes": _V + """, c AS (SELECT vec_id, unnest(e) AS v, unnest(range(len(e))) AS col FROM v)
SELECT CAST(col AS INTEGER) AS col, round(min(v), 6) AS least, arg_min(vec_id, (v, vec_id)) AS least_at, round(max(v), 6) AS most, arg_max(vec_id, (v, -vec_id)) AS most_at FROM c GROUP BY col""",
    "topic_rollup": """WITH wl AS (SELECT doc_id, source AS corpus, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents), t AS (SELECT doc_id, corpus, unnest(l) AS term, unnest(range(len(l))) AS pos FROM wl), k AS (SELECT *, CAST((doc_id + pos) % 5 AS INTEGER) AS k FROM t)
SELECT corpus, k, count(*) AS tokens, count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms FROM k GROUP BY ROLLUP (corpus, k)""",
    "sorted_frequencies": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
top AS (SELECT term FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 500)
SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY term) AS counts FROM c WHERE term IN (SELECT term FROM top) GROUP BY doc_id""",
}
