"""Time buckets, the dense spine of slices, and counts cumulated over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_bucket(ts: Column) -> Column:
    """year * 12 + month, the month from 0."""
    return F.year(ts) * 12 + F.month(ts) - 1


def year_bucket(value: Column, kind: str = "timestamp") -> Column:
    """Year of a timestamp or date, of epoch milliseconds (``millis``), or an integer year (``year``)."""
    if kind == "millis":
        return F.year(F.timestamp_millis(value))
    return value.cast("int") if kind == "year" else F.year(value)


def label(bucket: Column, scale: str) -> Column:
    """``yyyyMM`` or ``yyyy``."""
    if scale == "year":
        return F.lpad(bucket.cast("string"), 4, "0")
    return F.concat(F.lpad(F.floor(bucket / 12).cast("string"), 4, "0"), F.lpad((F.pmod(bucket, F.lit(12)) + 1).cast("string"), 2, "0"))


def spine(docs: DataFrame, bucket: Column, scale: str = "month") -> DataFrame:
    """(time_idx, bucket, label): every bucket from the first to the last, empty ones included."""
    ends = docs.select(bucket.alias("b")).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo IS NOT NULL")
    rows = ends.select("lo", F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return rows.select((F.col("bucket") - F.col("lo")).cast("int").alias("time_idx"), "bucket", label(F.col("bucket"), scale).alias("label"))


def dense_grid(times: DataFrame, groups: DataFrame) -> DataFrame:
    """Every slice with every group. ``times`` grows with the calendar only and is sent to the tasks of ``groups`` as one array."""
    packed = times.agg(F.collect_list(F.struct(*times.columns)).alias("t"))
    return groups.join(F.broadcast(packed)).select(*groups.columns, F.explode("t").alias("s")).select(*groups.columns, "s.*")


def cumulative(counts: DataFrame, groups: list[str], time: str, n: str, out: str) -> DataFrame:
    """Counts over all slices up to each one."""
    window = Window.partitionBy(*groups).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn(out, F.sum(n).over(window))
