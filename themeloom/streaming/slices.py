"""Clusters through time from a stream: every micro-batch joins the model so far.

The model is the table of assignments; each batch is predicted against it and appended, and the
batch's number makes a repeated batch replace its own rows only, so results are exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.plans.scoring import reassign


def slice_writer(model_path: str, tf_of: Callable[[DataFrame], DataFrame], weights: dict[int, float], alpha: float, b0: float, n_terms: int) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over documents (doc_id, corpus, text, ...).

    ``model_path`` holds assignments (doc_id, corpus, k) and their term counts under ``assign`` and ``tf``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        assign = spark.read.parquet(f"{model_path}/assign").where(F.col("batch") < number)
        counted = spark.read.parquet(f"{model_path}/tf").where(F.col("batch") < number)
        fresh = batch.select("doc_id", "corpus").dropDuplicates(["doc_id"]).withColumn("k", F.lit(None).cast("int"))
        own = tf_of(batch).select("doc_id", "term", "n")
        placed = reassign(assign, counted.select("doc_id", "term", "n").unionByName(own), weights, 0.0, alpha, b0, n_terms, False, False, targets=fresh)
        result = fresh.drop("k").join(placed.select("doc_id", F.col("k").cast("int").alias("k")), "doc_id")
        result.write.mode("overwrite").parquet(f"{model_path}/assign/batch={number}")
        own.write.mode("overwrite").parquet(f"{model_path}/tf/batch={number}")

    return write
