"""Queries over the text model, each with the SQL that checks it.

Labels are deterministic (``doc_id % 5``, and per token ``(doc_id + pos) % 5``), so that everything
that follows from given assignments can be compared with SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions import search, special, text, vectors
from themeloom.operators import evolution, stats, timeline
from themeloom.plans import clustering, packed, scoring, topics
from themeloom.plans.lineage import cut, spread
from themeloom.sources import records

K, B0, ALPHA, TOP = 5, 0.5, 1.0, 10
#: A short stop list for the checks.
STOP = ("the", "of", "and", "with", "for", "by", "an", "in", "de", "la", "les", "und")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("corpus"), "ts", "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.tokens(_docs(spark, d).select("doc_id", "corpus", "text"))


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return text.term_frequencies(_tokens(spark, d), "doc_id", "corpus")


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, corpus, term, n) of the pruned vocabulary."""
    tf = _tf(spark, d)
    return tf.join(text.vocabulary(tf).select("term"), "term").select("doc_id", "corpus", "term", "n")


def _assign(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "corpus", (F.col("doc_id") % K).cast("int").alias("k"))


def _lengths(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "corpus", *more, F.size(text.words(F.col("text"))).cast("bigint").alias("len"))


def _months(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("ts IS NOT NULL")
    return docs.withColumn("bucket", timeline.month_bucket(F.col("ts")))


def tokenize_counts(spark, d):
    return _tokens(spark, d).groupBy("term").agg(F.count("*").alias("n"))


def token_positions(spark, d):
    return _tokens(spark, d).select("doc_id", "pos", "term")


def stopword_filter(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP], "term string")
    return text.without_stop_words(_tokens(spark, d), stop).groupBy("doc_id").agg(F.count("*").alias("n"))


def vocab_pruned(spark, d):
    return text.dense_ids(text.vocabulary(_tf(spark, d)), "term").select("w", "term", "tf", "df")


def term_df_idf(spark, d):
    n = _docs(spark, d).agg(F.count("*").alias("n_docs"))
    counts = text.vocabulary(_tf(spark, d), min_tf=0)
    return counts.join(F.broadcast(n)).select("term", "df", F.round(text.idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))


def doc_tf(spark, d):
    return _pruned(spark, d).select("doc_id", "term", "n")


def doc_feature_sequence(spark, d):
    vocab = text.dense_ids(text.vocabulary(_tf(spark, d)), "term")
    return text.sequences(_tokens(spark, d), vocab).select("doc_id", F.array_join("seq", " ").alias("seq"))


def corpus_stats(spark, d):
    return stats.corpus_stats(_lengths(spark, d), "corpus").withColumn("avg_len", F.round("avg_len", 6))


def corpus_stats_rollup(spark, d):
    return stats.corpus_rollup(_lengths(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


def corpus_messages(spark, d):
    return stats.stats_message(stats.corpus_stats(_lengths(spark, d), "corpus").withColumn("avg_len", F.floor("avg_len").cast("double")))


def time_corpus_stats(spark, d):
    months = _lengths(spark, d, "ts").where("ts IS NOT NULL").withColumn("bucket", timeline.month_bucket(F.col("ts")))
    spine = timeline.spine(months, F.col("bucket"))
    grid = timeline.dense_grid(spine.select("time_idx", "bucket"), months.select("corpus").distinct())
    cells = stats.corpus_stats(months, "corpus", "bucket")
    return grid.join(cells, ["corpus", "bucket"], "left").select("time_idx", "corpus", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round("avg_len", 6).alias("avg_len"))


def month_spine(spark, d):
    return timeline.spine(_months(spark, d), F.col("bucket")).select("time_idx", "label")


def year_spine(spark, d):
    docs = _docs(spark, d).where("ts IS NOT NULL").withColumn("y", timeline.year_bucket(F.col("ts")))
    return timeline.spine(docs, F.col("y"), "year").select("time_idx", "label")


def empty_cells(spark, d):
    return time_corpus_stats(spark, d).where("docs = 0").select("time_idx", "corpus")


def corpus_names(spark, d):
    known = spark.read.parquet(f"{d}/mix_targets.parquet").select(F.col("source").alias("name")).where("name < 'm'")
    docs = _docs(spark, d).select("doc_id", "corpus")
    return docs.join(known, docs.corpus == known.name, "left").select("doc_id", F.coalesce("name", F.lit("Unknown name.")).alias("name"))


def cumulative_cluster_sizes(spark, d):
    months = _months(spark, d).withColumn("k", (F.col("doc_id") % K).cast("int"))
    local = months.groupBy("corpus", "k", "bucket").agg(F.count("*").alias("n"))
    return timeline.cumulative(local, ["corpus", "k"], "bucket", "n", "n_upto").select("corpus", "k", "bucket", "n", "n_upto")


def _search(spark, d, query):
    rows = spark.read.parquet(f"{d}/bib_records.parquet").dropDuplicates(["rec_id"])
    fields = {c: c for c in rows.columns} | {"confName": "conf_name"}
    return rows.where(search.parse_query(query, fields, "title")).select("rec_id")


def search_term(spark, d):
    return _search(spark, d, "abstract:newspapers")


def search_boolean(spark, d):
    return _search(spark, d, "abstract:newspapers AND NOT (title:dynamic OR year:2004)")


def search_all(spark, d):
    return _search(spark, d, "*:*")


def sample_fraction_hash(spark, d):
    return text.sample_exact(_docs(spark, d).select("doc_id"), 0.25, "doc_id", 3)


def kfold_mod(spark, d):
    return text.folds(_docs(spark, d).select("doc_id"), 10, "doc_id")


def parse_labelled_records(spark, d):
    raw = spark.read.parquet(f"{d}/bib_records.parquet").groupBy("rec_id").agg(*[F.max(F.coalesce(F.regexp_replace(F.col(c), r"[\r\n]+", " "), F.lit(""))).alias(c) for c in ("year", "title", "abstract", "keywords", "author")], F.max("link").alias("link"))
    body = F.concat(F.lit("year: "), "year", F.lit("\r\ntitle: "), "title", F.lit("\r\n"), "link", F.lit("\r\nabstract: "), "abstract", F.lit("\nkeywords: "), "keywords", F.lit("\nauthor: "), "author", F.lit("\n"))
    lines = raw.select(F.col("rec_id").cast("string").alias("file"), F.posexplode(F.split(body, "\r?\n")).alias("pos", "value"))
    return records.split_records(lines, "vis").select(F.col("file").cast("bigint").alias("rec_id"), "year", "title", "uri", "conf_name")


def cluster_stats(spark, d):
    return stats.component_sizes(_assign(spark, d)).join(_labelled(spark, d).groupBy("k").agg(F.sum("n").alias("tokens")), "k")


def _labelled(spark, d, pruned=True):
    tf = _pruned(spark, d) if pruned else _tf(spark, d)
    return tf.withColumn("k", (F.col("doc_id") % K).cast("int"))


def cluster_members(spark, d):
    return stats.members(_assign(spark, d))


def cluster_keywords(spark, d):
    return stats.top_terms(stats.component_terms(_labelled(spark, d)), ["k"], TOP)


def cluster_keywords_text(spark, d):
    return stats.render_keywords(cluster_keywords(spark, d), ["k"])


def cluster_keywords_by_corpus(spark, d):
    return stats.top_terms(stats.component_terms(_labelled(spark, d), "corpus"), ["corpus", "k"], TOP)


def cluster_rollup(spark, d):
    return _labelled(spark, d).rollup("k", "corpus").agg(F.sum("n").alias("tokens"), F.grouping_id().cast("int").alias("level"))


def _topic_tokens(spark, d):
    return _tokens(spark, d).withColumn("k", ((F.col("doc_id") + F.col("pos")) % K).cast("int"))


def topic_stats(spark, d):
    return _topic_tokens(spark, d).groupBy("corpus", "k").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"))


def topic_keywords(spark, d):
    counts = _topic_tokens(spark, d).groupBy("k", "term").agg(F.count("*").alias("n_kw"))
    return stats.top_terms(counts, ["k"], TOP)


def doc_topic_matrix(spark, d):
    return _topic_tokens(spark, d).groupBy("doc_id", "k").agg(F.count("*").alias("n"))


def topics_per_doc(spark, d):
    return stats.topics_per_document(_topic_tokens(spark, d))


def _moves(spark, d):
    return _docs(spark, d).select("doc_id", (F.col("doc_id") % 7).cast("int").alias("old"), (F.col("doc_id") % K).cast("int").alias("new"))


def _live(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("k"))


def split_matrix(spark, d):
    return evolution.transitions(_moves(spark, d), "old", "new", _live(spark, 8)).withColumn("share", F.round("share", 6))


def merge_matrix(spark, d):
    return evolution.transitions(_moves(spark, d), "new", "old", _live(spark, 4)).withColumn("share", F.round("share", 6))


def split_keywords(spark, d):
    return evolution.flow_keywords(_moves(spark, d), _pruned(spark, d), "old", "new", 3)


def timeslice_summary(spark, d):
    docs = _docs(spark, d).where("ts IS NOT NULL").select("doc_id", F.year("ts").alias("y"), (F.col("doc_id") % K).cast("int").alias("k"))
    first = docs.agg(F.min("y").alias("lo"))
    assign = docs.join(F.broadcast(first)).select("doc_id", "k", (F.col("y") - F.col("lo")).alias("time_idx"))
    return evolution.slice_summary(assign, _pruned(spark, d), _live(spark, K + 1), 1, 3)


def _vec(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def vec_add(spark, d):
    return _vec(spark, d).select("vec_id", F.round(vectors.total(vectors.add(F.col("e"), vectors.scale(F.col("e"), 2.0))), 4).alias("s"))


def vec_dot(spark, d):
    return _vec(spark, d).select("vec_id", F.round(vectors.dot(F.col("e"), F.reverse("e")), 6).alias("dot"))


def vec_norm2(spark, d):
    return _vec(spark, d).select("vec_id", F.round(vectors.norm2(F.col("e")), 5).alias("norm2"))


def vec_minmax(spark, d):
    both = _vec(spark, d).select("vec_id", vectors.first_max(F.col("e")).alias("hi"), vectors.first_min(F.col("e")).alias("lo"))
    return both.select("vec_id", F.col("hi.index").alias("max_at"), F.col("lo.index").alias("min_at"), F.round("hi.value", 6).alias("max_v"), F.round("lo.value", 6).alias("min_v"))


def vec_topk(spark, d):
    return _vec(spark, d).select("vec_id", F.array_join(vectors.top_indices(F.col("e"), 5), ",").alias("top"))


def matrix_row_col_stats(spark, d):
    cells = _vec(spark, d).select("vec_id", F.posexplode("e").alias("col", "v"))
    by = lambda axis, key: cells.groupBy(key).agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 6).alias("top"), F.round(F.min("v"), 6).alias("low")).select(F.lit(axis).alias("axis"), F.col(key).cast("bigint").alias("i"), "total", "top", "low")
    return by("row", "vec_id").unionByName(by("col", "col"))


def sparse_from_dense(spark, d):
    s = vectors.sparse(F.transform("e", lambda x: F.when(x > 0.1, x).otherwise(0.0)))
    return _vec(spark, d).select("vec_id", s.alias("s")).select("vec_id", F.col("s.dim").alias("dim"), F.array_join("s.idx", ",").alias("idx"))


def sparse_dense_dot(spark, d):
    s = vectors.sparse(F.transform("e", lambda x: F.when(x > 0.1, x).otherwise(0.0)))
    return _vec(spark, d).select("vec_id", F.round(vectors.sparse_dense_dot(s, F.col("e")), 6).alias("dot"))


def unique_counts(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("n"))


def positions_of_values(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label")
    wanted = spark.range(12).select(F.col("id").cast("int").alias("label"))
    numbered = rows.select("label", F.col("vec_id"))
    return wanted.join(numbered, "label", "left").select("label", "vec_id")


def mean_std(spark, d):
    e = F.col("e")
    return _vec(spark, d).select("vec_id", F.round(vectors.mean(e), 6).alias("mean"), F.round(vectors.deviation(e), 6).alias("sd"))


def normalize_tf(spark, d):
    tf = _pruned(spark, d)
    return tf.select("doc_id", "term", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 6).alias("p"))


def _corpus_probabilities(spark, d):
    counts = cut(_pruned(spark, d).groupBy("corpus", "term").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("corpus").agg(F.sum("n").alias("total"))
    return counts.join(totals, "corpus").select("corpus", "term", "n", (F.col("n") / F.col("total")).alias("p"))


def _divergence(spark, d):
    """Of each corpus from all corpora together, over the union of supports."""
    p = _corpus_probabilities(spark, d)
    everything = p.groupBy("term").agg(F.sum("n").alias("n"))
    total = everything.agg(F.sum("n").alias("total"))
    q = everything.join(F.broadcast(total)).select("term", (F.col("n") / F.col("total")).alias("q"))
    # terms that a corpus lacks add the same whatever the corpus, so the union of supports needs no grid
    absent = q.select(F.sum(special.kl_term(F.lit(0.0), F.col("q"))).alias("a_pq"), F.sum(special.kl_term(F.col("q"), F.lit(0.0))).alias("a_qp"))
    pq, qp = special.kl_term(F.col("p"), F.col("q")) - special.kl_term(F.lit(0.0), F.col("q")), special.kl_term(F.col("q"), F.col("p")) - special.kl_term(F.col("q"), F.lit(0.0))
    per = p.join(q, "term").groupBy("corpus").agg(F.sum(pq).alias("pq"), F.sum(qp).alias("qp"))
    return per.join(F.broadcast(absent)).select("corpus", (F.col("pq") + F.col("a_pq")).alias("kl"), (F.col("qp") + F.col("a_qp")).alias("kl_back"))


def kl_corpora(spark, d):
    return _divergence(spark, d).select("corpus", F.round("kl", 4).alias("kl"))


def sym_kl_corpora(spark, d):
    return _divergence(spark, d).select("corpus", F.round((F.col("kl") + F.col("kl_back")) / 2, 4).alias("sym_kl"))


def posterior_loglik(spark, d):
    like = F.transform(F.slice("e", 1, 5), lambda x: x * 100.0)
    post = vectors.posterior(like, F.array(*[F.lit(0.2)] * 5))
    return _vec(spark, d).select("vec_id", F.posexplode(post).alias("k", "p")).withColumn("p", F.round("p", 6))


def sumlog_range(spark, d):
    return _lengths(spark, d).select("doc_id", F.round(special.sum_log(F.lit(0.0), (F.col("len") - 1).cast("double"), F.lit(B0)), 4).alias("s"))


def _model(spark, d) -> tuple[DataFrame, int]:
    """Counts of the pruned vocabulary, tokenised and written once, and the number of its terms."""
    pruned = cut(_pruned(spark, d))
    return pruned, pruned.select("term").distinct().count()


def doc_log_marginal(spark, d):
    pruned, n = _model(spark, d)
    return scoring.marginals(_assign(spark, d), pruned, B0, n, True, list(range(K))).select("doc_id", "k", F.round("logmarg", 4).alias("logmarg"))


def doc_empty_marginal(spark, d):
    pruned, n = _model(spark, d)
    return scoring.empty_marginals(_docs(spark, d), pruned, B0, B0 * n).select("doc_id", F.round("logmarg_new", 4).alias("logmarg"))


def cluster_loglik(spark, d):
    pruned, n = _model(spark, d)
    return scoring.cluster_loglik(_assign(spark, d), pruned, B0, n).select("doc_id", "k", F.round("logmarg", 4).alias("logmarg"))


def token_loglik(spark, d):
    toks = _topic_tokens(spark, d)
    n = toks.select("term").distinct().count()
    return topics.token_loglik(toks, B0, n).select("doc_id", F.round("loglik", 4).alias("loglik"))


_WEIGHTS = {k: 0.15 for k in range(K)}


def map_reassign(spark, d):
    pruned, n = _model(spark, d)
    return scoring.reassign(_assign(spark, d), pruned, _WEIGHTS, 0.25, ALPHA, B0, n).select("doc_id", "k")


def map_reassign_with_new(spark, d):
    pruned, n = _model(spark, d)
    return scoring.reassign(_assign(spark, d), pruned, _WEIGHTS, 0.25, ALPHA, B0, n, True, True).select("doc_id", "k")


def predict_cluster(spark, d):
    pruned, n = _model(spark, d)
    return scoring.reassign(_assign(spark, d), pruned, _WEIGHTS, 0.25, ALPHA, B0, n, False, False).select("doc_id", "k")


def predict_token_probs(spark, d):
    counts = _topic_tokens(spark, d).groupBy("k", "term").agg(F.count("*").alias("n_kw"))
    n = counts.select("term").distinct().count()
    return scoring.token_predictive(counts, _WEIGHTS, ALPHA, B0, n).withColumn("p", F.round("p", 6))


def _small_model(spark, d):
    """Documents and counts with term ids for fitting."""
    tf = cut(_pruned(spark, d))
    vocab = cut(text.dense_ids(tf.select("term").distinct(), "term"))
    return _docs(spark, d).select("doc_id", "corpus"), cut(tf.join(vocab, "term")), vocab.count()


def fit_clusters_batch(spark, d):
    p = clustering.ClusterParams(iterations=3, seed=1)
    docs = cut(spread(_docs(spark, d).select("doc_id", "corpus", "text")).select("doc_id", "corpus", text.words(F.col("text")).alias("words")))
    # a term's total count needs no counts by document
    kept = text.vocabulary(docs.select("doc_id", F.explode("words").alias("term"), F.lit(1).alias("n"))).select("term")
    vocab = cut(text.dense_ids(kept, "term"))
    n = vocab.count()
    if n * (p.initial + p.births) > packed.MAX_CELLS:
        docs, tf, n = _small_model(spark, d)
        return clustering.fit_batch(docs, tf, n, p).assign
    tf = lambda: cut(text.term_frequencies(docs.select("doc_id", "corpus", F.explode("words").alias("term")), "doc_id", "corpus").join(vocab, "term"))
    return clustering.fit_batch(docs, tf, n, p, vocab=vocab).assign


def fit_clusters_exact(spark, d):
    docs, tf, n = _small_model(spark, d)
    return clustering.fit_exact(docs, tf, n, clustering.ClusterParams(iterations=1, seed=1)).assign


def fit_topics(spark, d):
    _, tf, n = _small_model(spark, d)
    toks = _tokens(spark, d).join(tf.select("term", "w").distinct(), "term").select("doc_id", "corpus", "pos", "w")
    return topics.fit_topics(toks, n, topics.TopicParams(iterations=1, seed=1, shard_tokens=20_000)).tokens.select("doc_id", "pos", "w", "k")


def _years_fit(spark, d):
    """The incremental fit over the years of the full spine; documents without a time have no slice."""
    docs, tf, n = _small_model(spark, d)
    dated = _docs(spark, d).where("ts IS NOT NULL")
    years = timeline.spine(dated, timeline.year_bucket(F.col("ts")), "year").select("time_idx", "bucket")
    bucketed = dated.select("doc_id", timeline.year_bucket(F.col("ts")).alias("bucket"))
    sliced = docs.join(bucketed.join(F.broadcast(years), "bucket").select("doc_id", "time_idx"), "doc_id")
    return clustering.fit_incremental(cut(sliced), tf, n, clustering.ClusterParams(seed=1))


def _reports(fit, kind):
    """One kind of report of all slices."""
    parts = [df.select(F.lit(int(name.removeprefix(f"{kind}_"))).alias("time_idx"), "*") for name, df in fit.reports.items() if name.startswith(f"{kind}_")]
    return reduce(DataFrame.unionByName, parts)


def incremental_fit(spark, d):
    return _years_fit(spark, d).assign


def incremental_summary(spark, d):
    return _reports(_years_fit(spark, d), "summary")


def incremental_splits(spark, d):
    return _reports(_years_fit(spark, d), "output")


def incremental_merges(spark, d):
    return _reports(_years_fit(spark, d), "input")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, token_positions, stopword_filter, vocab_pruned, term_df_idf, doc_tf, doc_feature_sequence, corpus_stats, corpus_stats_rollup, corpus_messages, time_corpus_stats, month_spine, year_spine, empty_cells, corpus_names,
        cumulative_cluster_sizes, search_term, search_boolean, search_all, sample_fraction_hash, kfold_mod, parse_labelled_records, cluster_stats, cluster_members, cluster_keywords, cluster_keywords_text, cluster_keywords_by_corpus, cluster_rollup,
        topic_stats, topic_keywords, doc_topic_matrix, topics_per_doc, split_matrix, merge_matrix, split_keywords, timeslice_summary, vec_add, vec_dot, vec_norm2, vec_minmax, vec_topk, matrix_row_col_stats, sparse_from_dense, sparse_dense_dot, unique_counts,
        positions_of_values, mean_std, normalize_tf, kl_corpora, sym_kl_corpora, posterior_loglik, sumlog_range, doc_log_marginal, doc_empty_marginal, cluster_loglik, token_loglik, map_reassign, map_reassign_with_new, predict_cluster, predict_token_probs,
        fit_clusters_batch, fit_clusters_exact, fit_topics, incremental_fit, incremental_summary, incremental_splits, incremental_merges,
    )
}
