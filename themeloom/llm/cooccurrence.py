"""Items that appear together: pair counts and lift by heavy-light decomposition.

Items are heavy when they occur in more than ``postings / heavy_items`` records; at most
``heavy_items`` items can be heavy, whatever the data. Records are packed into rows of
item codes once. Every Arrow batch of such rows is a block:

* heavy-heavy pairs: the block's bit matrix (one row of packed bits per heavy item) gives
  all counts by AND and population count;
* heavy-light pairs: the records of each light item probe the bit matrix;
* light-light pairs: hash-counted in the JVM from each record's light items. A record with many of them is
  first cut into segments; pairs of segments are rows of their own and spread over the executors, so that no task
  forms the pairs of a whole large record.

Blocks emit counts, not pairs of records, and a hash aggregate adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.plans.lineage import cut

#: Bytes for the bits that one step of AND and population count holds.
STEP_BYTES = 1 << 25
#: Light items in one segment of a record; a row makes at most the square of it in pairs.
SEGMENT = 256


def _bits(rows: np.ndarray, items: np.ndarray, n_items: int, n_rows: int) -> np.ndarray:
    """Bit matrix: one row of 64-bit words per heavy item, one bit per record of the block."""
    words = -(-max(n_rows, 1) // 64)
    dense = np.zeros((n_items, words * 8), np.uint8)
    np.bitwise_or.at(dense, (items, rows >> 3), np.uint8(1) << (rows & 7).astype(np.uint8))
    return dense.view(np.uint64)


def block_counts(heavy: list[np.ndarray], light: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) over one block: heavy codes are smaller than light ones. Pairs of heavy items count in rows that
    are ``own``; the others repeat the heavy items of a record for further segments of its light ones."""
    n = len(heavy)
    rows = np.repeat(np.arange(n), [len(x) for x in heavy])
    items = np.concatenate(heavy).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    used, local = np.unique(items, return_inverse=True)
    bits = _bits(rows, local, len(used), n)
    out_a, out_b, out_n = [], [], []
    step = max(1, STEP_BYTES // max(1, bits.nbytes))
    rows_own = _bits(np.flatnonzero(own), np.zeros(int(own.sum()), np.int64), 1, n)[0]
    for i in range(0, len(used), step):
        both = np.bitwise_count((bits[i : i + step] & rows_own)[:, None, :] & bits[None, :, :]).sum(2, dtype=np.int64)
        x, y = np.nonzero(both)
        keep = used[i + x] < used[y]
        x, y = x[keep], y[keep]
        out_a.append(used[i + x]), out_b.append(used[y]), out_n.append(both[x, y])
    light_rows = np.repeat(np.arange(n), [len(x) for x in light])
    light_items = np.concatenate(light).astype(np.int64) if len(light_rows) else np.zeros(0, np.int64)
    if len(light_items) and len(used):
        # probe: the bits of every light posting's record, one heavy item at a time
        order = np.argsort(light_items, kind="stable")
        light_rows, light_items = light_rows[order], light_items[order]
        names, first = np.unique(light_items, return_index=True)
        as_bytes = bits.view(np.uint8)
        byte, shift = light_rows >> 3, (light_rows & 7).astype(np.uint8)
        for k, item in enumerate(used):
            hits = np.add.reduceat(((as_bytes[k, byte] >> shift) & 1).astype(np.int64), first)
            some = np.flatnonzero(hits)
            out_a.append(np.full(len(some), item)), out_b.append(names[some]), out_n.append(hits[some])
    if not out_a:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            heavy, light = ([np.asarray(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("heavy", "light"))
            a, b, n = block_counts(heavy, light, np.array(batch.column("own").to_pylist(), bool))
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()) for x in (a, b, n)], names=["a", "b", "n_ab"])


def item_counts(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """(item, n): number of baskets with each item; nulls in either column are left out."""
    distinct = baskets.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    return distinct.groupBy("item").agg(F.count("*").alias("n"))


def pair_lift(baskets: DataFrame, basket: str, item: str, min_together: int = 1, min_lift: float = 0.0, heavy_items: int | None = None) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, lift) of every pair of different items, item_a < item_b.

    ``lift`` is n_ab * N / (n_a * n_b), N the number of baskets with at least one item. Pairs
    below ``min_together`` or ``min_lift`` are left out; items that cannot reach them are
    dropped before pairs are formed, which is exact because n_ab is at most the smaller of
    n_a and n_b.

    ``heavy_items`` bounds the number of heavy items, and by that the bit matrix of a block; by default it is chosen so that
    a light item stands in at most ten thousand records or one in 512 of all postings, whichever is less, and is at most 16 384.

    Defined cases: repeated (basket, item) rows count once; null baskets and items are left
    out; an empty table gives no rows; other columns are ignored.
    """
    spark = baskets.sparkSession
    rows = cut(baskets.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct())
    total = rows.agg(F.count_distinct("basket").alias("n")).first()["n"]
    counts = rows.groupBy("item").agg(F.count("*").alias("n"))
    useful = counts.where((F.col("n") >= min_together) & (F.col("n") * F.lit(float(min_lift)) <= float(total)))
    postings = useful.agg(F.sum("n").alias("n")).first()["n"] or 0
    if heavy_items is None:
        heavy_items = int(min(16_384, max(512, postings / 10_000)))
    heavy_from = max(1.0, postings / heavy_items)
    # heavy items get the codes 0.., at most heavy_items of them, so they may go to the driver
    heavy = [r["item"] for r in useful.where(F.col("n") > heavy_from).select("item").collect()]
    item_type = useful.schema["item"].dataType
    numbered = spark.createDataFrame(list(zip(sorted(heavy), range(len(heavy)))), T.StructType([T.StructField("item", item_type), T.StructField("number", T.LongType())]))
    light_code = F.xxhash64("item").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(heavy_items)
    # the table of heavy items is as small as the list; a join instead of a map of as many literals
    coded = useful.join(numbered, "item", "left").select("item", "n", F.coalesce("number", light_code).alias("code"))
    coded = cut(coded)
    if coded.groupBy("code").count().where("count > 1").limit(1).count():
        raise ValueError("two items share a hash code")
    # a segment holds some of a record's light codes, chosen by hash; the record's heavy codes, at most heavy_items, go with segment 0
    posted = rows.join(coded, "item").select("basket", "code")
    held = posted.groupBy("basket").agg(F.count_if(F.col("code") >= heavy_items).alias("n_light"))
    segments = F.greatest(F.lit(1), F.ceil(F.col("n_light") / SEGMENT))
    in_segment = F.when(F.col("code") < heavy_items, F.lit(0)).otherwise(F.pmod(F.xxhash64("code"), segments))
    packed = cut(
        posted.join(held, "basket")
        .select("basket", "code", segments.alias("segments"), in_segment.cast("int").alias("segment"))
        .groupBy("basket", "segment")
        .agg(F.collect_list("code").alias("codes"), F.max("segments").alias("segments"))
        .select(
            "basket",
            "segment",
            "segments",
            F.filter("codes", lambda c: c < heavy_items).alias("heavy"),
            F.array_sort(F.filter("codes", lambda c: c >= heavy_items)).alias("light"),
        )
    )
    # records of several segments: their heavy codes meet each segment, and their segments each other
    large = packed.where("segments > 1")
    heads = large.where("segment = 0").select("basket", F.col("heavy").alias("head"))
    whole = packed.where((F.col("segments") == 1) & (F.size("heavy") + F.size("light") > 1)).select("heavy", "light", F.lit(True).alias("own"))
    cut_up = large.join(heads, "basket").select(F.col("head").alias("heavy"), "light", (F.col("segment") == 0).alias("own"))
    dense = whole.unionByName(cut_up).where(F.size("heavy") > 0).mapInArrow(_dense, "a bigint, b bigint, n_ab bigint")
    # each light item with the later light items of its segment, and with those of later segments: counted by hash before the shuffle
    inside = packed.where(F.size("light") > 1).select(F.posexplode("light").alias("i", "a"), "light")
    inside = inside.select("a", F.explode(F.slice("light", F.col("i") + 2, F.size("light"))).alias("b"))
    later = large.select("basket", F.col("segment").alias("later"), F.col("light").alias("others"))
    across = large.select("basket", "segment", "light", "segments").join(later, "basket").where("later > segment")
    # pairs of segments are few and small as rows; they move apart before they are multiplied out
    across = across.repartition(F.xxhash64("basket", "segment", "later")).select(F.explode("light").alias("x"), "others").select("x", F.explode("others").alias("y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    light = inside.unionByName(across).withColumn("n_ab", F.lit(1).cast("bigint"))
    pairs = dense.unionByName(light).groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= min_together)
    named = pairs.join(coded.select(F.col("code").alias("a"), F.col("item").alias("item_1"), F.col("n").alias("n_1")), "a").join(
        coded.select(F.col("code").alias("b"), F.col("item").alias("item_2"), F.col("n").alias("n_2")), "b"
    )
    swap = F.col("item_1") > F.col("item_2")
    lift = F.col("n_ab") * F.lit(float(total)) / (F.col("n_1") * F.col("n_2"))
    result = named.select(
        F.when(swap, F.col("item_2")).otherwise(F.col("item_1")).alias("item_a"),
        F.when(swap, F.col("item_1")).otherwise(F.col("item_2")).alias("item_b"),
        F.when(swap, F.col("n_2")).otherwise(F.col("n_1")).alias("n_a"),
        F.when(swap, F.col("n_1")).otherwise(F.col("n_2")).alias("n_b"),
        "n_ab",
        lift.alias("lift"),
    )
    return result.where(F.col("n_ab") * F.lit(float(total)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
