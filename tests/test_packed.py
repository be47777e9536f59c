import pytest
from test_models import planted

from pyspark.sql import functions as F

from themeloom.functions import text
from themeloom.plans import clustering, packed, queries, scoring

WEIGHTS = {0: 0.2, 1: 0.2, 5: 0.3}


def test_scores_are_those_of_sql(spark):
    docs, tf, n_terms = planted(spark)
    tf = tf.withColumn("n", F.when(F.col("doc_id") == 4, F.col("n") * 20).otherwise(F.col("n")))
    assign = docs.withColumn("k", F.when(F.col("doc_id") == 7, 5).otherwise(F.col("doc_id") % 2).cast("int"))  # 5 has one document
    rows = packed.pack(assign, tf, 4)
    state = packed.count(rows, n_terms, 0.5)
    for leave_out, new, by_time in ((True, True, False), (True, True, True), (False, False, True)):
        want = {r["doc_id"]: r["k"] for r in scoring.reassign(assign, tf, WEIGHTS, 0.3, 1.0, 0.5, n_terms, leave_out, new, by_time=by_time).collect()}
        placed, after = packed.place(rows, state, WEIGHTS, 0.3, 1.0, leave_out, new, by_time, 100)
        got = {r["doc_id"]: -1 if r["k"] >= 100 else r["k"] for r in placed.collect()}
        again = packed.count(placed, n_terms, 0.5)
        assert got == want and after.local == again.local and (after.n_kw == again.n_kw).all()
    want = scoring.cluster_loglik(assign, tf, 0.5, n_terms).agg(F.sum("logmarg")).first()[0]
    assert abs(packed.loglik(rows, state) - want) < 1e-6


def test_fit_with_and_without_a_state(spark, monkeypatch):
    docs, tf, n_terms = planted(spark, per=4)
    found = []
    for cells in (packed.MAX_CELLS, 0):
        monkeypatch.setattr(packed, "MAX_CELLS", cells)
        fit = clustering.fit_batch(docs, tf, n_terms, clustering.ClusterParams(iterations=1, seed=2, initial=3))
        found.append(({tuple(r) for r in fit.assign.collect()}, round(fit.metrics[0]["loglik"], 6)))
    assert found[0] == found[1]


def test_a_sweep_is_one_pass(spark):
    docs, tf, n_terms = planted(spark)
    counts = []
    for iterations in (1, 4):
        spark.sparkContext.setJobGroup(f"fit-{iterations}", "")
        clustering.fit_batch(docs, tf, n_terms, clustering.ClusterParams(iterations=iterations, seed=1))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{iterations}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the pass, and the likelihood with its final sum
    assert counts[1] - counts[0] <= 3 * 3


def test_exact_has_no_limit_of_its_own(spark):
    docs, tf, n_terms = planted(spark)
    many = tf.withColumn("n", F.col("n") * 10_000)  # more than two million tokens
    found = {}
    for r in clustering.fit_exact(docs, many, n_terms, clustering.ClusterParams(iterations=4, seed=3, initial=4)).assign.where("doc_id < 999").collect():
        found.setdefault(r["k"], set()).add(r["doc_id"] % 3)
    assert all(len(groups) == 1 for groups in found.values())


def test_words_are_packed_as_their_counts(spark):
    texts = [(1, "a", "b b a zz"), (2, "a", ""), (3, "b", None), (4, None, "c a c b b q"), (5, "b", "zz")]
    docs = spark.createDataFrame(texts, "doc_id long, corpus string, text string").select("doc_id", "corpus", F.lit(0).alias("time_idx"), F.lit(1).alias("k"), text.words(F.col("text")).alias("words"))
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, w long")
    tf = text.term_frequencies(docs.select("doc_id", F.explode("words").alias("term")), "doc_id").join(vocab, "term")
    want = packed.pack(docs.drop("words"), tf, 5)
    got = packed.pack_words(docs, vocab, 5)
    assert got.schema == want.schema and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_batch_query_does_not_move_words(spark, monkeypatch):
    """No exchange by document: neither counts by document and term nor documents are grouped."""
    for name in ("term_frequencies", "sequences"):
        monkeypatch.setattr(text, name, lambda *_, **__: pytest.fail("counts by document"))
    monkeypatch.setattr(packed, "pack", lambda *_: pytest.fail("documents from their counts"))
    assert queries.fit_clusters_batch(spark, "/root/testdata/sf0.001").count() == 100
