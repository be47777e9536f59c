"""Nonparametric topic models of tokens, for one corpus or several.

Sweeps are Gibbs draws per token. Documents are dealt to shards of bounded size; each
shard works on a private copy of the topic-term counts and their changes are added up
(approximate distributed sampling, Newman et al. 2009). With one shard the sweep is the
sequential one. New topics of a shard get provisional ids that become dense at the merge.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import random as R
from themeloom.plans import hyper
from themeloom.plans.clustering import new_component
from themeloom.plans.lineage import cut


@dataclass
class TopicParams:
    b0: float = 0.5
    alpha: float = 1.0
    gamma: float = 1.0
    xi: float = 1.0
    alpha_prior: tuple[float, float] | None = None
    gamma_prior: tuple[float, float] | None = None
    xi_prior: tuple[float, float] | None = None
    initial: int = 5
    iterations: int = 5
    seed: int = 0
    crp: str = "exact"
    shard_tokens: int = 500_000
    max_cells: int = 50_000_000


@dataclass
class TopicFit:
    """Token topics (doc_id, corpus, pos, w, k), global and per-corpus weights, concentrations, metrics."""

    tokens: DataFrame
    weights: dict[int, float]
    unseen: float
    corpus_weights: dict[str, tuple[dict[int, float], float]]
    alpha: dict[str, float]
    gamma: float
    xi: float
    metrics: list[dict] = field(default_factory=list)


def break_sticks(rng: np.random.Generator, corpora: dict, above: tuple[dict, float] | None, gamma: float, xi: float, k: int) -> tuple[dict, tuple[dict, float] | None]:
    """A new topic ``k`` takes a piece of the unseen weight of every corpus; returns the weights by corpus and those above them.

    With weights above the corpora (global ones, and their unseen part) these are broken first, by Beta(xi, 1) for what stays unseen; a corpus'
    piece then follows Beta(gamma * unseen above, gamma * new weight above). Without them it is Beta(gamma, 1).
    """
    if above is not None:
        known, unseen = dict(above[0]), above[1]
        unseen = new_component(rng, known, unseen, xi, k)
        above = known, unseen
    out = {}
    for j, (own, rest) in corpora.items():
        own = dict(own)
        if above is None:
            rest = new_component(rng, own, rest, gamma, k)
        else:
            v = R.beta(rng, gamma * above[1], gamma * above[0][k])
            own[k], rest = rest * (1 - v), rest * v
        out[j] = own, rest
    return out, above


def _sweep_shard(frame: pd.DataFrame, counts: dict[int, np.ndarray], n_terms: int, b0: float, alpha: dict, weights: dict, rng: np.random.Generator, above: tuple[dict, float] | None = None, gamma: float = 1.0, xi: float = 1.0) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "pos"]).reset_index(drop=True)
    ids = sorted(counts)
    table = np.stack([counts[k] for k in ids] + [np.zeros(n_terms)]).astype(float)
    totals = table.sum(1)
    slot, fresh = {k: i for i, k in enumerate(ids)}, 0
    z = [slot[k] for k in frame["k"].tolist()]
    out = np.empty(len(frame), np.int64)
    docs = frame["doc_id"].to_numpy()
    w = frame["w"].to_numpy()
    edges = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]) if len(docs) else np.array([0])
    big = b0 * n_terms
    broken = {j: (dict(b), u) for j, (b, u) in weights.items()}
    corpora = frame["corpus"].tolist()
    prior: dict = {}  # weights of each corpus as an array, until a new topic changes them
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        j = corpora[x]
        n_d = np.bincount(z[x:y], minlength=len(table)).astype(float)
        for i in range(x, y):
            k, word = z[i], w[i]
            n_d[k] -= 1
            table[k, word] -= 1
            totals[k] -= 1
            if j not in prior:
                prior[j] = alpha[j] * np.array([broken[j][0].get(name, 0.0) for name in ids])
            u = broken[j][1]
            m = len(ids)
            p = np.where(totals[:m] > 0, (n_d[:m] + prior[j]) * (np.maximum(table[:m, word], 0) + b0) / (totals[:m] + big), 0.0)
            pick = R.categorical(rng, np.append(p, alpha[j] * u / n_terms))
            if pick == m:
                fresh += 1
                ids.append(-fresh)
                broken, above = break_sticks(rng, broken, above, gamma, xi, -fresh)
                prior.clear()
                table, totals, n_d = np.vstack([table, np.zeros(n_terms)]), np.append(totals, 0.0), np.append(n_d, 0.0)
            z[i] = pick
            n_d[pick] += 1
            table[pick, word] += 1
            totals[pick] += 1
        out[x:y] = [ids[k] for k in z[x:y]]
    return frame.assign(k=out)


def _shard_runner(sent, n_terms: int, b0: float, seed: int, it: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts, weights, alpha, above, gamma, xi = sent.value
        rng = R.generator(seed, it, int(frame["shard"].iloc[0]) + 1)
        return _sweep_shard(frame, counts, n_terms, b0, alpha, weights, rng, above, gamma, xi)[["doc_id", "corpus", "pos", "w", "k", "shard"]]

    return run


def _table_counts(rng, rows, weights, alpha, crp) -> dict:
    """Tables by (corpus, k) from (corpus, k, n, documents with that n)."""
    tables: dict = {}
    for j, k, n, times in sorted(rows):
        share = weights[j][0].get(k, 1e-9)
        tables[j, k] = tables.get((j, k), 0) + R.crp_tables(rng, int(n), alpha[j] * share, crp, int(times))
    return tables


def fit_topics(tokens: DataFrame, n_terms: int, p: TopicParams, shared: bool = True) -> TopicFit:
    """Topics of (doc_id, corpus, pos, w), w in 0..n_terms-1. ``shared``: corpora have weights of their own under global ones; else one level only."""
    spark = tokens.sparkSession
    rows = tokens.select("doc_id", (F.col("corpus") if shared else F.lit("all")).alias("corpus"), "pos", F.col("w").cast("bigint").alias("w"))
    current = cut(rows.withColumn("k", (F.pmod(F.xxhash64(F.lit(p.seed), "doc_id", "pos"), F.lit(p.initial)) + 1).cast("bigint")))
    corpora = [r[0] for r in current.select("corpus").distinct().orderBy("corpus").collect()]
    n_tokens = current.count()
    shards = max(1, -(-n_tokens // p.shard_tokens))
    piece = 1.0 / (p.initial + 1)
    start = {k: piece for k in range(1, p.initial + 1)}
    weights, unseen = dict(start), piece
    local = {j: (dict(start), piece) for j in corpora}
    alpha, gamma, xi, following = {j: p.alpha for j in corpora}, p.gamma, p.xi, p.initial + 1
    schema, metrics = "doc_id bigint, corpus string, pos int, w bigint, k bigint, shard int", []
    for it in range(p.iterations):
        began, rng = time.time(), R.generator(p.seed, it)
        counts: dict[int, np.ndarray] = {}
        for r in current.groupBy("k", "w").agg(F.count("*").alias("n")).toLocalIterator():
            if r["k"] not in counts:
                if (len(counts) + 1) * n_terms > p.max_cells:
                    raise ValueError("topics times terms exceed max_cells; prune the vocabulary")
                counts[r["k"]] = np.zeros(n_terms, np.int64)
            counts[r["k"]][r["w"]] = r["n"]
        sent = spark.sparkContext.broadcast((counts, local, alpha, (weights, unseen) if shared else None, gamma, xi))  # at most max_cells counts

        shard = F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(shards)).cast("int")
        swept = cut(current.withColumn("shard", shard).groupBy("shard").applyInPandas(_shard_runner(sent, n_terms, p.b0, p.seed, it), schema))
        born = [(r["shard"], r["k"]) for r in swept.where("k < 0").select("shard", "k").distinct().orderBy("shard", F.desc("k")).collect()]
        if born:
            table = spark.createDataFrame([(s, k, following + i) for i, (s, k) in enumerate(born)], "shard int, k bigint, to bigint")
            following += len(born)
            swept = cut(swept.join(F.broadcast(table), ["shard", "k"], "left").withColumn("k", F.coalesce("to", "k")).drop("to"))  # a few new topics
        current = swept.select("doc_id", "corpus", "pos", "w", "k")
        # documents matter only by how many have each count: a short table, however many there are
        per_doc = current.groupBy("corpus", "doc_id", "k").agg(F.count("*").alias("n"))
        histogram = [tuple(r) for r in per_doc.groupBy("corpus", "k", "n").agg(F.count("*").alias("times")).collect()]
        tables = _table_counts(rng, histogram, local, alpha, p.crp)
        live = sorted({k for _, k in tables})
        meta: dict[int, int] = {}
        for (j, k), m in sorted(tables.items()):
            meta[k] = meta.get(k, 0) + (R.crp_tables(rng, m, gamma * weights.get(k, 1e-9), p.crp) if shared else m)
        top = xi if shared else gamma
        draw = R.dirichlet(rng, [*(meta[k] for k in live), top])
        weights, unseen = dict(zip(live, draw[:-1].tolist())), float(draw[-1])
        for j in corpora:
            if shared:
                d = R.dirichlet(rng, [*(gamma * weights[k] + tables.get((j, k), 0) for k in live), gamma * unseen])
                local[j] = (dict(zip(live, d[:-1].tolist())), float(d[-1]))
            else:
                local[j] = (dict(weights), unseen)
        if p.alpha_prior:
            lengths: dict = {}
            for r in per_doc.groupBy("corpus", "doc_id").agg(F.sum("n").alias("n")).groupBy("corpus", "n").count().orderBy("corpus", "n").collect():
                lengths.setdefault(r["corpus"], []).append((r["n"], r["count"]))
            for j in corpora:
                own = lengths.get(j, [])
                alpha[j] = hyper.resample_alpha(rng, alpha[j], [n for n, _ in own], sum(m for (c, _), m in tables.items() if c == j), *p.alpha_prior, times=[m for _, m in own])
        if p.gamma_prior:
            if shared:
                sizes = [sum(m for (c, _), m in tables.items() if c == j) for j in corpora]
                gamma = hyper.resample_alpha(rng, gamma, sizes, sum(meta.values()), *p.gamma_prior)
            else:
                gamma = hyper.resample_gamma(rng, gamma, sum(meta.values()), len(live), *p.gamma_prior)
        if shared and p.xi_prior:
            xi = hyper.resample_gamma(rng, xi, sum(meta.values()), len(live), *p.xi_prior)
        named = current.withColumnRenamed("w", "term")
        loglik = token_loglik(named, p.b0, n_terms).agg(F.sum("loglik")).first()[0]
        local_k = {j: sum(1 for (c, _), m in tables.items() if c == j and m) for j in corpora}
        metrics.append({"iter": it, "k": len(live), "local_k": local_k, "loglik": loglik, "alpha": dict(alpha), "gamma": gamma, "xi": xi, "ms": int(1000 * (time.time() - began))})
    return TopicFit(current, weights, unseen, local, alpha, gamma, xi, metrics)


def token_loglik(tokens: DataFrame, b0: float, n_terms: int) -> DataFrame:
    """(doc_id, loglik): sum over a document's tokens of ln (n_kw + b0) / (n_k + B)."""
    n_kw = tokens.groupBy("k", "term").agg(F.count("*").alias("n_kw"))
    n_k = tokens.groupBy("k").agg(F.count("*").alias("n_k"))
    joined = tokens.groupBy("doc_id", "k", "term").agg(F.count("*").alias("n")).join(n_kw, ["k", "term"]).join(n_k, "k")
    return joined.groupBy("doc_id").agg(F.sum(F.col("n") * F.log((F.col("n_kw") + b0) / (F.col("n_k") + b0 * n_terms))).alias("loglik"))


def predict_tokens(tokens: DataFrame, predictive: DataFrame, seed: int) -> DataFrame:
    """(doc_id, pos, k): a seeded draw of a topic for each held-out token, independent of partitioning."""
    scored = tokens.join(predictive, "term")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "pos", "k"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    key = F.log("p") - F.log(-F.log(u))
    return scored.groupBy("doc_id", "pos").agg(F.max_by("k", F.struct(key, -F.col("k"))).alias("k"))
