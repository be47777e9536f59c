import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from themeloom.plans import clustering, scoring, topics
from themeloom.plans import queries as model_queries
from themeloom.sources import records
from themeloom.streaming.slices import slice_writer


def planted(spark, per=8, words=6, seed=0):
    """Three groups of disjoint words, two corpora, three slices, one empty document."""
    rng, docs, tf = random.Random(seed), [], []
    for i in range(3 * per):
        g = i % 3
        docs.append((i, "ab"[i % 2], i * 3 // (3 * per)))
        for w, n in Counter(g * words + rng.randrange(words) for _ in range(15)).items():
            tf.append((i, "ab"[i % 2], f"t{w:02d}", w, n))
    docs.append((999, "a", 2))
    return spark.createDataFrame(docs, "doc_id bigint, corpus string, time_idx int"), spark.createDataFrame(tf, "doc_id bigint, corpus string, term string, w int, n bigint"), 3 * words


def test_scores_against_brute_force(spark):
    docs, tf, n_terms = planted(spark)
    assign = docs.select("doc_id", "corpus", (F.col("doc_id") % 2).cast("int").alias("k"))
    rows = {}
    for r in tf.collect():
        rows.setdefault(r["doc_id"], {})[r["w"]] = r["n"]
    k_of = {r["doc_id"]: r["k"] for r in assign.collect()}
    lg, b0 = math.lgamma, 0.5
    for out in (True, False):
        for r in scoring.marginals(assign, tf, b0, n_terms, out, [0, 1]).collect():
            have = Counter()
            for d, k in k_of.items():
                if k == r["k"] and not (out and d == r["doc_id"]):
                    have.update(rows.get(d, {}))
            own = rows.get(r["doc_id"], {})
            n_k, length = sum(have.values()), sum(own.values())
            want = sum(lg(b0 + have[w] + n) - lg(b0 + have[w]) for w, n in own.items()) - (lg(b0 * n_terms + n_k + length) - lg(b0 * n_terms + n_k))
            assert r["logmarg"] == pytest.approx(want, abs=1e-8)


def test_planted_groups(spark):
    docs, tf, n_terms = planted(spark)
    for fit in (clustering.fit_exact, clustering.fit_batch):
        done = fit(docs, tf, n_terms, clustering.ClusterParams(iterations=6, seed=3, initial=4))
        got = {}
        for r in done.assign.where("doc_id < 999").collect():
            got.setdefault(r["k"], set()).add(r["doc_id"] % 3)
        assert all(len(g) == 1 for g in got.values()), fit
        assert sum(done.weights.values()) + done.new_weight == pytest.approx(1)
    with pytest.raises(ValueError):
        clustering.fit_exact(docs, tf, n_terms, clustering.ClusterParams(max_tokens=1))


def test_incremental_and_topics(spark):
    docs, tf, n_terms = planted(spark, per=4)
    done = clustering.fit_incremental(docs, tf, n_terms, clustering.ClusterParams(iterations=1, seed=2, initial=3))
    assert done.assign.count() == docs.count() and {"summary_0", "output_1", "input_2"} <= set(done.reports)
    assert done.reports["output_1"].groupBy("predicted").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    toks = tf.select("doc_id", "corpus", F.posexplode(F.array_repeat("w", F.col("n").cast("int"))).alias("p", "w")).withColumn("pos", (F.col("w") * 100 + F.col("p")).cast("int"))
    for shared in (True, False):
        p = topics.TopicParams(iterations=2, seed=4, shard_tokens=100, alpha_prior=(1, 1), gamma_prior=(1, 1), xi_prior=(1, 1))
        fit = topics.fit_topics(toks, n_terms, p, shared)
        assert fit.tokens.count() == toks.count() and fit.tokens.where("k < 1").count() == 0
        assert sum(fit.weights.values()) + fit.unseen == pytest.approx(1)


def test_incremental_slices(spark, tmp_path, monkeypatch):
    rows = [(i, "abc"[i % 3], "alpha beta gamma", datetime.datetime(y, 5, 1) if y else None) for i, y in enumerate((2001, 2001, 2002, 2004, None))]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, ts timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    reports = {f"{kind}_{t}": spark.range(1).select("id") for kind in ("summary", "output", "input") for t in (1, 3)}
    monkeypatch.setattr(clustering, "fit_incremental", lambda docs, tf, n, p: clustering.ClusterFit(docs, {}, 1.0, p.iterations, 1.0, reports=reports))
    assert {(r["doc_id"], r["time_idx"]) for r in model_queries.QUERIES["incremental_fit"](spark, str(tmp_path)).collect()} == {(0, 0), (1, 0), (2, 1), (3, 3)}
    for name in ("incremental_summary", "incremental_splits", "incremental_merges"):
        assert {tuple(r) for r in model_queries.QUERIES[name](spark, str(tmp_path)).collect()} == {(1, 0), (3, 0)}


def test_incremental_empty_slice(spark):
    docs, tf, n_terms = planted(spark, per=4)
    docs = docs.withColumn("time_idx", F.when(F.col("time_idx") > 0, 2).otherwise(0))
    done = clustering.fit_incremental(docs, tf, n_terms, clustering.ClusterParams(iterations=1, seed=2, initial=3))
    assert done.assign.count() == docs.count() and {f"{kind}_{t}" for kind in ("summary", "output", "input") for t in (1, 2)} <= set(done.reports)
    assert done.reports["summary_1"].where("size > 0").count() == 0 and done.reports["summary_1"].count() > 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("year: 2001\ntitle: A: b\nlink: http://x\nabstract: t\nkeywords: k\nauthor: A B\n\nyear: 2002\ntitle: C\nlink: u\nabstract: z\nkeywords:\nauthor: D\n")
    both = records.read_labelled(spark, str(tmp_path / "a.txt"), "infovis")
    assert [(r["year"], r["title"], r["mislabelled"]) for r in both.orderBy("record").collect()] == [("2001", "A: b", 0), ("2002", "C", 0)]
    path = str(tmp_path / "index")
    records.write_index(both, path, True)
    records.write_index(both.withColumn("conf_name", F.lit("vis")), path, False)
    assert records.load_index(spark, path, "confName:infovis").count() == 2 and records.load_index(spark, path, "*:*", fraction=0.5).count() == 2
    (tmp_path / "s.txt").write_bytes("﻿The\r\nof\r\nOF\r\n\r\n".encode())
    assert sorted(r["term"] for r in records.read_stop_words(spark, str(tmp_path / "s.txt")).collect()) == ["of", "the"]


def test_stream_of_slices(spark, tmp_path):
    docs, tf, n_terms = planted(spark)
    model = str(tmp_path)
    known = docs.where("time_idx < 2 and doc_id < 999")
    known.select("doc_id", "corpus", (F.col("doc_id") % 3).cast("int").alias("k")).write.parquet(f"{model}/assign/batch=-1")
    tf.join(known.select("doc_id"), "doc_id").select("doc_id", "term", "n").write.parquet(f"{model}/tf/batch=-1")
    fresh = docs.where("time_idx = 2 and doc_id < 999")
    write = slice_writer(model, lambda batch: tf.join(batch.select("doc_id"), "doc_id"), {0: 0.3, 1: 0.3, 2: 0.3}, 1.0, 0.5, n_terms)
    for _ in range(2):  # a repeated batch replaces itself
        write(fresh, 0)
    got = spark.read.parquet(f"{model}/assign").where("batch = 0").collect()
    assert len(got) == fresh.count() and all(r["k"] == r["doc_id"] % 3 for r in got)


def test_counts_up_to_the_own_slice(spark):
    """n_tjk summed over t' <= t, against a serial count."""
    docs, tf, n_terms = planted(spark)
    assign = docs.select("doc_id", "corpus", "time_idx", (F.col("doc_id") % 2).cast("int").alias("k"))
    rows = [tuple(r) for r in assign.collect()]
    got = {(r["doc_id"], r["k"]): r["n_jk_left"] for r in scoring.marginals(assign, tf, 0.5, n_terms, True, [0, 1], by_time=True).collect()}
    for d, j, t, z in rows:
        for k in (0, 1):
            want = sum(1 for e, i, u, y in rows if i == j and y == k and u <= t) - (z == k)
            assert got[d, k] == want
    late = assign.where("time_idx = 2").withColumn("k", F.lit(None).cast("int"))
    early = assign.where("time_idx < 2")
    scored = {(r["doc_id"], r["k"]): r["n_jk_left"] for r in scoring.marginals(early, tf, 0.5, n_terms, False, [0, 1], late, True).collect()}
    for d, j, t, _ in rows:
        if t == 2:
            assert scored[d, 0] == sum(1 for e, i, u, y in rows if i == j and y == 0 and u < 2)


def test_given_labels_and_births(spark):
    docs, tf, n_terms = planted(spark)
    labels = docs.where("doc_id < 999").select("doc_id", F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("label"))
    assert {tuple(r) for r in clustering.given_labels(docs, labels).collect()} == {(i, i % 3) for i in range(24)} | {(999, 3)}
    for fit in (clustering.fit_exact, clustering.fit_batch):
        done = fit(docs, tf, n_terms, clustering.ClusterParams(iterations=1, seed=1), labels)
        found = {r["doc_id"]: r["k"] for r in done.assign.collect()}
        assert all(len({found[d] for d in range(g, 24, 3)}) == 1 for g in range(3)) and done.metrics[0]["local_k"]["a"] >= 3
    # documents that prefer a new component found several, by their leading term
    one = docs.select("doc_id", "corpus", F.lit(0).alias("k"))
    moved = clustering.sweep(one, tf, {0: 1e-12}, 1.0, 50.0, 0.01, n_terms, True, 1, births=4)
    assert moved.select("k").distinct().count() > 2


def test_reports_are_written(spark, tmp_path):
    docs, tf, n_terms = planted(spark, per=2)
    done = clustering.fit_incremental(docs.where("time_idx < 2"), tf, n_terms, clustering.ClusterParams(iterations=1, seed=2, initial=2), report_path=str(tmp_path / "r"))
    written = spark.read.json(str(tmp_path / "r" / "output"))
    assert written.count() == done.reports["output_1"].count() and {r[0] for r in written.select("time_idx").distinct().collect()} == {1}


def test_index_keeps_texts_with_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "T", None, "c", "2001"), ("u2", None, "body", "c", "2003"), ("u3", None, None, "d", None)], "uri string, title string, abstract string, conf_name string, year string")
    path = str(tmp_path / "i")
    records.write_index(rows, path, True)
    assert {(r["uri"], r["text"]) for r in records.load_index(spark, path, "*:*").collect()} == {("u1", "T"), ("u2", "body"), ("u3", "")}
    made = records.load_corpora(spark, path, "*:*")
    assert {tuple(r) for r in made["docs"].collect()} == {("u1", "c", 0), ("u2", "c", 2), ("u3", "d", None)}
    with pytest.raises(ValueError):
        records.from_lists(spark, ["a"], [], [], [])
