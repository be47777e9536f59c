import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import random as R
from themeloom.functions import search, special, text
from themeloom.functions import vectors as V
from themeloom.operators import evolution, stats, timeline
from themeloom.plans import hyper


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_lgamma(spark):
    xs = [0.01, 0.5, 1.0, 2.5, 17.0, 1e3, 4e6]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.lgamma(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r["y"], math.lgamma(r["x"]), rel_tol=1e-11, abs_tol=1e-10) for r in rows)
    assert one(spark, special.sum_log(F.lit(2.0), F.lit(4.0), F.lit(0.5))) == pytest.approx(sum(math.log(j + 0.5) for j in (2, 3, 4)))
    assert one(spark, special.sum_log(F.lit(2.0), F.lit(1.0), F.lit(0.5))) == 0


def test_vectors(spark):
    assert one(spark, V.top_indices(arr(1, 2, 3, 4), 3)) == [3, 2, 1]
    assert one(spark, V.top_indices(arr(-4, -1, -1, -3), 9)) == [1, 2, 3, 0]
    assert one(spark, V.first_max(arr(1, 4, 4))).asDict() == {"value": 4.0, "index": 1}
    assert one(spark, V.first_max(F.array().cast("array<double>"))) is None
    assert one(spark, V.deviation(arr(3))) is None and one(spark, V.deviation(arr(1, 3))) == pytest.approx(math.sqrt(2))
    assert one(spark, V.normalise(arr(0, 0))) == [0, 0] and one(spark, V.normalise(arr(1, 3))) == [0.25, 0.75]
    assert one(spark, V.dense(V.sparse(arr(1, 2, 0, 4)))) == [1, 2, 0, 4] and one(spark, V.sparse(arr(1, 2, 0, 4)))["idx"] == [0, 1, 3]
    assert one(spark, V.render(arr(1, 2), pattern="%.1f")) == "[1.0,2.0,]"
    assert one(spark, V.transpose(F.array(arr(1, 2, 3), arr(4, 5, 6)))) == [[1, 4], [2, 5], [3, 6]]
    assert one(spark, V.posterior(arr(-1e4, 0, 0), arr(1, 1, 3))) == pytest.approx([0, 0.25, 0.75])
    assert one(spark, V.symmetric_kl(arr(0.5, 0.5), arr(0.5, 0.5))) == 0
    m = lambda **kv: F.create_map(*[F.lit(x) for i, v in kv.items() for x in (i, float(v))])
    assert one(spark, V.map_add(m(a=1, b=2), m(b=3))) == {"a": 1, "b": 5}
    assert one(spark, V.map_dot(m(a=1, b=2), m(b=3))) == 6 and one(spark, V.map_kl(m(a=1), m(b=1))) == pytest.approx(1.0001 * math.log(1.0001 / 1e-4) + 1e-4 * math.log(1e-4 / 1.0001))


def test_search(spark):
    df = spark.createDataFrame([(1, "Graph layout", "infovis"), (2, "Text graphs", "vis"), (3, None, "infovis")], "id int, title string, conf_name string")
    fields = {"title": "title", "confName": "conf_name"}
    find = lambda q: [r["id"] for r in df.where(search.parse_query(q, fields, "title")).orderBy("id").collect()]
    assert find("confName:infovis") == [1, 3] and find("*:*") == [1, 2, 3] and find("graph") == [1] and find('title:"graph layout"') == [1]
    assert find("confName:infovis AND NOT title:graph") == [3] and find("graph OR graphs") == [1, 2] and find("graph graphs") == [1, 2] and find("(graph OR graphs) AND confName:vis") == [2]
    with pytest.raises(ValueError):
        search.parse_query("nope:x", fields, "title")


def test_text_and_time(spark):
    df = spark.createDataFrame([(1, "a", "Aa bb aa"), (2, "a", ""), (3, "b", None)], "doc_id int, corpus string, text string")
    toks = text.tokens(df)
    assert sorted((r["doc_id"], r["pos"], r["term"]) for r in toks.collect()) == [(1, 0, "aa"), (1, 1, "bb"), (1, 2, "aa")]
    vocab = text.dense_ids(text.vocabulary(text.term_frequencies(toks, "doc_id"), min_tf=0), "term")
    assert [(r["w"], r["term"]) for r in vocab.orderBy("w").collect()] == [(0, "aa"), (1, "bb")]
    assert [r["seq"] for r in text.sequences(toks, vocab).collect()] == [[0, 1, 0]]
    assert text.sample_exact(df, 0.7, "doc_id").count() == 2
    dates = spark.sql("SELECT * FROM VALUES (timestamp'1999-11-02'), (timestamp'2000-02-03'), (null) AS t(ts)")
    rows = timeline.spine(dates.where("ts IS NOT NULL"), timeline.month_bucket(F.col("ts"))).orderBy("time_idx").collect()
    assert [r["label"] for r in rows] == ["199911", "199912", "200001", "200002"]
    assert timeline.spine(dates.where("ts IS NULL"), timeline.month_bucket(F.col("ts"))).count() == 0


def test_transitions_and_ties(spark):
    moves = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 9, 1)], "doc_id int, old int, new int")
    live = spark.createDataFrame([(0,), (5,)], "k int")
    got = {(r["old"], r["new"]): (r["size"], r["share"], r["source_alive"]) for r in evolution.transitions(moves, "old", "new", live).collect()}
    assert got == {(0, 1): (1, 0.5, True), (0, 2): (1, 0.5, True), (9, 1): (1, 1.0, False), (5, 5): (0, 1.0, True)}
    counts = spark.createDataFrame([(0, "b", 2), (0, "a", 2), (0, "c", 5)], "k int, term string, n_kw int")
    assert [r["term"] for r in stats.top_terms(counts, ["k"], 2).orderBy("rank").collect()] == ["c", "a"]


def test_random():
    rng = R.generator(1, 2)
    assert sorted(R.permutation(rng, 10).tolist()) == list(range(10))
    d = R.dirichlet(rng, [0.0, 0.0, 1e-12, 5])
    assert d.sum() == pytest.approx(1) and (d > 0).all()
    for crp in ("exact", "reference"):
        n, alpha, times = 40, 2.0, 3000
        draws = [R.crp_tables(R.generator(i), n, alpha, crp) for i in range(times)]
        assert all(1 <= t <= n for t in draws)
        assert abs(np.mean(draws) - R.expected_crp_tables(n, alpha, crp)) < 5 * np.std(draws) / math.sqrt(times)
    assert R.crp_tables(rng, 0, 1.0) == 0 and 0 < R.beta(rng, 0, 0) < 1
    assert R.categorical_sequence(rng, [], 3).tolist() == [0, 0, 0]
    counts = np.bincount(R.categorical_sequence(rng, [0.2, 0.8], 20000), minlength=2)
    assert abs(counts[1] / 20000 - 0.8) < 0.02
    assert R.initial_labels(R.generator(5), 50, 3).tolist() == R.initial_labels(R.generator(5), 50, 3).tolist()
    assert hyper.resample_gamma(rng, 1.0, 20, 5, 1, 1) > 0 and hyper.resample_alpha(rng, 1.0, [10, 20, 0], 8, 1, 1) > 0


def test_required_and_prohibited_clauses(spark):
    df = spark.createDataFrame([(1, "Daten für alle"), (2, "plain b"), (3, "b"), (4, "plain"), (5, None)], "id int, title string")
    find = lambda q: [r["id"] for r in df.where(search.parse_query(q, {"title": "title"}, "title")).orderBy("id").collect()]
    assert find("title:für") == [1] and find("+plain b") == [2, 4] and find("+plain +b") == [2] and find("plain -b") == [4] and find("b plain") == [2, 3, 4]


def test_exact_samples(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("h", F.lit("clash"))
    few = text.sample_exact(df, 0.31, "doc_id", 3)
    ids = {r["doc_id"] for r in few.collect()}
    assert len(ids) == few.count() == 1550 and few.columns == ["doc_id", "h"] and ids == {r["doc_id"] for r in text.sample_exact(df.repartition(7), 0.31, "doc_id", 3).collect()}
    assert text.sample_exact(df, 0.0, "doc_id").count() == 0 and text.sample_exact(df, 1.0, "doc_id").count() == 5000 and text.sample_exact(df.limit(0), 0.5, "doc_id").count() == 0
