"""How components change between two labellings of the same documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.stats import top_terms


def transitions(moves: DataFrame, row: str, column: str, live: DataFrame) -> DataFrame:
    """(row, column, size, share, source_alive): flows between two labellings, shares by row.

    Live components (k) without a flow get an edge to themselves with share 1 and size 0. Rows of
    components that are no longer live are kept and marked; drop them for reports on live ones only.
    """
    flows = moves.groupBy(row, column).agg(F.count("*").alias("size"))
    flows = flows.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(row)))
    alive = live.select(F.col("k").alias(row)).distinct().withColumn("source_alive", F.lit(True))
    joined = flows.join(alive, row, "full")
    return joined.select(row, F.coalesce(column, F.col(row)).alias(column), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("share", F.lit(1.0)).alias("share"), F.coalesce("source_alive", F.lit(False)).alias("source_alive"))


def flow_keywords(moves: DataFrame, tf: DataFrame, row: str, column: str, top: int) -> DataFrame:
    """(row, column, term, n, rank): leading terms of each flow."""
    counts = moves.select("doc_id", row, column).join(tf.select("doc_id", "term", "n"), "doc_id").groupBy(row, column, "term").agg(F.sum("n").alias("n"))
    return top_terms(counts, [row, column], top, "n")


def slice_summary(assign: DataFrame, tf: DataFrame, live: DataFrame, slice_no: int, top: int) -> DataFrame:
    """(k, size, term, n, rank) of one slice: every live component, size 0 and no terms if it has no documents there."""
    here = assign.where(F.col("time_idx") == slice_no)
    sizes = here.groupBy("k").agg(F.count("*").alias("size"))
    counts = here.select("doc_id", "k").join(tf.select("doc_id", "term", "n"), "doc_id").groupBy("k", "term").agg(F.sum("n").alias("n"))
    ranked = top_terms(counts, ["k"], top, "n")
    return live.select("k").distinct().join(sizes, "k", "left").join(ranked, "k", "left").select("k", F.coalesce("size", F.lit(0)).alias("size"), "term", "n", "rank")
