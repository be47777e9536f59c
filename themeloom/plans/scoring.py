"""Scores of documents and tokens under Dirichlet-multinomial components, as DataFrame plans.

Terms a component lacks contribute what they would in an empty one, so that part is computed
once per document; only (document, component, term) triples whose term the component has are
joined. The product of terms and components is never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.special import log_rising


def component_state(assign: DataFrame, tf: DataFrame, by_time: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, term, n_kw), (k, n_k, docs), (corpus, k, n_jk) of assignments (doc_id, corpus, k).

    ``by_time``: assignments have a time_idx, and n_jk becomes ``history``, an array of (time_idx, n) of a corpus' slices.
    """
    n_kw = tf.select("doc_id", "term", "n").join(assign.select("doc_id", "k"), "doc_id").groupBy("k", "term").agg(F.sum("n").alias("n_kw"))
    tokens = n_kw.groupBy("k").agg(F.sum("n_kw").alias("n_k"))
    sizes = assign.groupBy("k").agg(F.count("*").alias("docs")).join(tokens, "k", "left").select("k", F.coalesce("n_k", F.lit(0)).alias("n_k"), "docs")
    local = assign.groupBy("corpus", "k").agg(F.count("*").alias("n_jk"))
    if by_time:
        local = assign.groupBy("corpus", "k", "time_idx").agg(F.count("*").alias("n")).groupBy("corpus", "k").agg(F.collect_list(F.struct("time_idx", "n")).alias("history"))
    return n_kw, sizes, local


def empty_marginals(docs: DataFrame, tf: DataFrame, b0: float, big_b: float | Column) -> DataFrame:
    """(doc_id, len, empty_terms, logmarg_new): log marginal of each document in an empty component; 0 without words."""
    b = F.lit(b0)
    per = tf.groupBy("doc_id").agg(F.sum("n").alias("len"), F.sum(log_rising(b, F.col("n"))).alias("empty_terms"))
    joined = docs.select("doc_id").join(per, "doc_id", "left").na.fill({"len": 0, "empty_terms": 0.0})
    total = big_b if isinstance(big_b, Column) else F.lit(big_b)
    return joined.withColumn("logmarg_new", F.when(F.col("len") == 0, 0.0).otherwise(F.col("empty_terms") - log_rising(total, F.col("len"))))


def marginals(assign: DataFrame, tf: DataFrame, b0: float, n_terms: int, leave_out: bool, n_components: list[int], targets: DataFrame | None = None, by_time: bool = False) -> DataFrame:
    """(doc_id, corpus, z, k, logmarg, docs_left, n_jk_left): every document against every live component.

    ``targets`` (doc_id, corpus, k) are the documents to score, by default all of ``assign``; with k
    null they are not part of the counts.

    ``leave_out``: without the document's own counts; a component that then has no document is left out.
    ``by_time``: a document sees its corpus' documents of its own slice and earlier ones only (n_tjk summed over t' <= t).
    """
    big_b = b0 * n_terms
    n_kw, sizes, local = component_state(assign, tf, by_time)
    own = (assign if targets is None else targets).select("doc_id", "corpus", F.col("k").alias("z"), *(["time_idx"] if by_time else []))
    tf = tf if targets is None else tf.join(own.select("doc_id"), "doc_id", "left_semi")
    base = empty_marginals(own, tf, b0, big_b)
    # the live components are a short list of numbers, so each document is repeated in place
    grid = base.join(own, "doc_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in n_components]))) if n_components else base.join(own, "doc_id").withColumn("k", F.lit(None).cast("int")).limit(0)
    is_own = F.col("k") == F.col("z")
    out = F.lit(1 if leave_out else 0)
    matched = tf.select("doc_id", "term", "n").join(own.select("doc_id", "z"), "doc_id").join(n_kw, "term")
    left = F.col("n_kw") - F.when(is_own, F.col("n")).otherwise(0) * out
    gain = F.when(left > 0, log_rising(F.lit(b0) + left, F.col("n")) - log_rising(F.lit(b0), F.col("n"))).otherwise(0.0)
    corrections = matched.groupBy("doc_id", "k").agg(F.sum(gain).alias("gain"))
    scored = grid.join(corrections, ["doc_id", "k"], "left").join(sizes, "k").join(local, ["corpus", "k"], "left")
    if by_time:
        upto = F.filter(F.coalesce("history", F.array().cast("array<struct<time_idx:int,n:bigint>>")), lambda h: h["time_idx"] <= F.col("time_idx"))
        scored = scored.withColumn("n_jk", F.aggregate(upto, F.lit(0).cast("bigint"), lambda acc, h: acc + h["n"]))
    mine = F.when(is_own, out).otherwise(0)
    n_k_left = F.col("n_k") - mine * F.col("len")
    logmarg = F.when(F.col("len") == 0, 0.0).otherwise(F.col("empty_terms") + F.coalesce("gain", F.lit(0.0)) - log_rising(F.lit(big_b) + n_k_left, F.col("len")))
    result = scored.select("doc_id", "corpus", "z", "k", logmarg.alias("logmarg"), (F.col("docs") - mine).alias("docs_left"), (F.coalesce("n_jk", F.lit(0)) - mine).alias("n_jk_left"), "logmarg_new")
    return result.where("docs_left > 0")


def reassign(assign: DataFrame, tf: DataFrame, weights: dict[int, float], new_weight: float, alpha: float, b0: float, n_terms: int, leave_out: bool = True, allow_new: bool = False, targets: DataFrame | None = None, by_time: bool = False) -> DataFrame:
    """(doc_id, k, score): best component of each document; ties to the smaller k, existing ones before a new one (k = -1).

    A document whose only component would be left empty stays where it is.
    """
    live = sorted(weights)
    docs = assign if targets is None else targets
    weight = F.element_at(F.create_map(*[F.lit(x) for k in live for x in (k, weights[k])]), F.col("k"))
    scored = marginals(assign, tf, b0, n_terms, leave_out, live, targets, by_time).withColumn("score", F.log(F.col("n_jk_left") + alpha * weight) + F.col("logmarg")).select("doc_id", "k", "score")
    if allow_new and abs(alpha) >= 1e-7 and new_weight > 0:
        base = empty_marginals(docs, tf, b0, b0 * n_terms)
        scored = scored.unionByName(base.select("doc_id", F.lit(-1).alias("k"), (F.lit(alpha * new_weight).cast("double")).alias("p"), "logmarg_new").select("doc_id", "k", (F.log("p") + F.col("logmarg_new")).alias("score")))
    order = F.when(F.col("k") >= 0, -F.col("k")).otherwise(-(1 << 31))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", order.alias("o"), "k")).alias("b")).select("doc_id", F.col("b.k").alias("new_k"), F.col("b.score").alias("score"))
    return docs.select("doc_id", F.col("k").alias("old_k")).join(best, "doc_id", "left").select("doc_id", F.coalesce("new_k", "old_k").alias("k"), "score")


def cluster_loglik(assign: DataFrame, tf: DataFrame, b0: float, n_terms: int) -> DataFrame:
    """(doc_id, k, logmarg): log marginal of each document in its own component, the document still counted."""
    n_kw, sizes, _ = component_state(assign, tf)
    big_b = b0 * n_terms
    terms = tf.select("doc_id", "term", "n").join(assign.select("doc_id", "k"), "doc_id").join(n_kw, ["k", "term"])
    per = terms.groupBy("doc_id").agg(F.sum(log_rising(F.lit(b0) + F.col("n_kw"), F.col("n"))).alias("s"), F.sum("n").alias("len"))
    joined = assign.select("doc_id", "k").join(per, "doc_id", "left").join(sizes, "k")
    value = F.when(F.col("len").isNull(), 0.0).otherwise(F.col("s") - log_rising(F.lit(big_b) + F.col("n_k"), F.col("len")))
    return joined.select("doc_id", "k", value.alias("logmarg"))


def token_predictive(topic_terms: DataFrame, weights: dict[int, float], alpha: float, b0: float, n_terms: int) -> DataFrame:
    """(term, k, p): probability of each topic for a new token of each term, for the terms of ``topic_terms`` (k, term, n_kw)."""
    live = sorted(weights)
    n_k = topic_terms.groupBy("k").agg(F.sum("n_kw").alias("n_k"))
    grid = topic_terms.select("term").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in live])))
    weight = F.element_at(F.create_map(*[F.lit(x) for k in live for x in (k, weights[k])]), F.col("k"))
    raw = grid.join(topic_terms, ["k", "term"], "left").join(n_k, "k").withColumn("raw", alpha * weight * (F.coalesce("n_kw", F.lit(0)) + b0) / (F.col("n_k") + b0 * n_terms))
    norm = raw.groupBy("term").agg(F.sum("raw").alias("norm"))
    return raw.join(norm, "term").select("term", "k", (F.col("raw") / F.col("norm")).alias("p"))
