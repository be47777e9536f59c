"""Statistics of corpora, components (clusters or topics) and their keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_stats(lengths: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, tokens, avg_len) from (doc_id, keys, len)."""
    return lengths.groupBy(*keys).agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("tokens"), F.avg("len").alias("avg_len"))


def corpus_rollup(lengths: DataFrame, key: str = "corpus") -> DataFrame:
    """As corpus_stats, with a row for all corpora (key null, is_total 1)."""
    grouped = lengths.rollup(key).agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"), F.avg("len").alias("avg_len"), F.grouping(key).cast("int").alias("is_total"))
    return grouped


def stats_message(stats: DataFrame, key: str = "corpus") -> DataFrame:
    """One formatted line per corpus."""
    line = F.format_string("%s: %d documents, %d tokens, %.2f on average", F.coalesce(F.col(key), F.lit("all")), "docs", "tokens", "avg_len")
    return stats.select(key, line.alias("message"))


def component_terms(labelled_tf: DataFrame, *keys: str) -> DataFrame:
    """(keys, k, term, n_kw) from (doc_id, keys, k, term, n)."""
    return labelled_tf.groupBy(*keys, "k", "term").agg(F.sum("n").alias("n_kw"))


def component_sizes(assign: DataFrame, *keys: str) -> DataFrame:
    """(keys, k, size) from one row per document."""
    return assign.groupBy(*keys, "k").agg(F.count("*").alias("size"))


def members(assign: DataFrame) -> DataFrame:
    """(k, doc_id): members as rows; a cluster is never gathered into one value or one task."""
    return assign.select("k", "doc_id")


def top_terms(counts: DataFrame, keys: list[str], top: int, n: str = "n_kw") -> DataFrame:
    """Counts with rank 1..top within the keys; ties to the smaller term."""
    order = Window.partitionBy(*keys).orderBy(F.desc(n), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def render_keywords(ranked: DataFrame, keys: list[str], n: str = "n_kw", pattern: str = "%s(%d),") -> DataFrame:
    """(keys, keywords): one line of ``term(n),`` per component, in the order of rank."""
    packed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "term", n))).alias("t"))
    return packed.select(*keys, F.array_join(F.transform("t", lambda x: F.format_string(pattern, x["term"], x[n])), " ").alias("keywords"))


def topics_per_document(tokens: DataFrame) -> DataFrame:
    """(doc_id, topics): number of distinct topics of a document's tokens."""
    return tokens.groupBy("doc_id").agg(F.count_distinct("k").alias("topics"))


def matrix_extremes(cells: DataFrame, along: str, other: str, value: str) -> DataFrame:
    """(along, least, least_at, most, most_at) of the cells of a matrix; ties go to the smaller position."""
    low, high = F.min(F.struct(value, F.col(other).alias("at"))), F.max(F.struct(value, (-F.col(other)).alias("at")))
    ends = cells.groupBy(along).agg(low.alias("low"), high.alias("high"))
    return ends.select(along, F.col(f"low.{value}").alias("least"), F.col("low.at").alias("least_at"), F.col(f"high.{value}").alias("most"), (-F.col("high.at")).alias("most_at"))


def topic_rollup(tokens: DataFrame) -> DataFrame:
    """(corpus, k, tokens, docs, terms) of token topics by corpus and topic, with totals where corpus or k is null."""
    cells = tokens.groupBy("corpus", "k", "doc_id", "term").agg(F.count("*").alias("n"))
    return cells.rollup("corpus", "k").agg(F.sum("n").alias("tokens"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("term").alias("terms"))
