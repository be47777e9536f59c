"""Mixing sources to target weights.

Documents are counted by exact length per source. A source's budget is first met by whole
repetitions; for the rest a bounded-knapsack programme chooses the number of documents of each length whose
total comes closest to it from below (see :func:`fit`). Only counts by length enter the programme, one group per
source. Documents are then selected by seeded hash, the wanted number of each length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.plans.lineage import cut, spread

BUCKETS = 1024


def pieces(text: Column) -> Column:
    """Number of whitespace-separated pieces; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))), F.lit(0)).cast("bigint")


def token_counts(docs: DataFrame, text: str, tokenizer: str, out: str = "size") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` by the tokenizer file at ``tokenizer``; 0 for null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for batch in batches:
            texts = [x or "" for x in batch.column(names.index(text)).to_pylist()]
            sizes = [len(e.ids) for i in range(0, len(texts), 512) for e in tok.encode_batch(texts[i : i + 512], add_special_tokens=False)]
            columns = [batch.column(i) for i, c in enumerate(names) if c != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*[c for c in names if c != text], out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return spread(docs).mapInArrow(run, f"{schema}, `{out}` bigint")


def _programme(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Bounded knapsack by bit sets: the numbers to take of each length for the largest total up to ``budget``."""
    full = (1 << (budget + 1)) - 1
    reach, stages = 1, []
    for i, n in enumerate(lengths):
        left, part = min(counts[i], budget // n), 1
        while left > 0:
            k = min(part, left)
            stages.append((i, k, reach))
            reach |= (reach << (n * k)) & full
            left -= k
            part *= 2
    at, take = reach.bit_length() - 1, [0] * len(lengths)
    for i, k, before in reversed(stages):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def fit(lengths: list[int], counts: list[int], budget: int, most_bits: int = 1 << 31) -> tuple[list[int], bool]:
    """How many documents of each length to take so that their total is the largest possible up to ``budget``; and whether that is proven.

    Counts are taken in proportion, then filled up from the longest. The programme runs over a few lengths and a few
    documents of each that may be exchanged; both double until the budget, rounded down to the lengths' common divisor, is met
    exactly or everything that could matter takes part: a best choice differs from a filled-up one in at most twice the longest length's
    number of documents. If that would need more than ``most_bits`` bits, the best choice so far is returned as unproven.
    Documents of length 0 are not taken.
    """
    take = [0] * len(lengths)
    usable = [i for i, n in enumerate(lengths) if 0 < n <= budget and counts[i] > 0]
    if not usable:
        return take, True
    total = sum(lengths[i] * counts[i] for i in usable)
    if total <= budget:
        for i in usable:
            take[i] = counts[i]
        return take, True
    goal = budget // math.gcd(*[lengths[i] for i in usable]) * math.gcd(*[lengths[i] for i in usable])
    for i in usable:
        take[i] = counts[i] * goal // total
    rest = goal - sum(lengths[i] * take[i] for i in usable)
    longest_first = sorted(usable, key=lambda i: -lengths[i])
    for i in longest_first:
        more = min(counts[i] - take[i], rest // lengths[i])
        take[i] += more
        rest -= more * lengths[i]
    width, most = 2, 32
    while rest:
        free = longest_first[-most:]  # the shortest first: they fill small gaps and need few bits
        back = [min(take[i], width) for i in free]
        spare = [min(counts[i] - take[i], width) + k for i, k in zip(free, back)]
        room = rest + sum(k * lengths[i] for i, k in zip(free, back))
        if room * sum(min(n, room // lengths[i]).bit_length() for i, n in zip(free, spare)) > most_bits:
            return take, False
        for i, k, n in zip(free, back, _programme([lengths[i] for i in free], spare, room)):
            take[i] += n - k
            rest += (k - n) * lengths[i]
        if most >= len(longest_first) and width >= min(max(counts[i] for i in usable), 2 * lengths[longest_first[0]] + 1):
            break
        width, most = 2 * width, 2 * most
    return take, True


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    lengths, counts = frame["size"].astype(int).tolist(), frame["docs"].astype(int).tolist()
    budget, most = int(frame["budget"].iloc[0]), int(frame["max_repeats"].iloc[0])
    size = sum(n * k for n, k in zip(lengths, counts))
    whole = min(budget // size, most) if size else 0
    extra, best = fit(lengths, counts, budget - whole * size) if whole < most else ([0] * len(lengths), True)
    return pd.DataFrame({"source": frame["source"], "size": lengths, "docs": counts, "whole": whole, "extra": extra, "best": best})


def length_counts(sized: DataFrame) -> DataFrame:
    """(source, size, docs): number of documents of each exact length per source, the only thing the programme needs of them."""
    return sized.groupBy("source", "size").agg(F.count("*").alias("docs"))


def source_budgets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, size, total, budget, reachable) of every target source, from counts by length.

    ``reachable``: whether ``max_repeats`` times the source's size suffices for its share of the total of all documents.
    """
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("size"))
    total = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(per, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    one = joined.join(F.broadcast(total))  # a single row of totals
    goal = F.col("target_share") * F.col("total")
    return one.select("source", "target_share", "max_repeats", "size", "total", F.round(goal).cast("bigint").alias("budget"), (F.col("max_repeats") * F.col("size") >= goal).alias("reachable"))


def mix_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, docs, whole, extra, best): per source and document length, how often all documents are taken, how many once more,
    and whether no other choice comes closer to the budget."""
    # one row per source and length: a group is bounded by the number of lengths, not of documents
    joined = counts.join(source_budgets(counts, targets).select("source", "budget", "max_repeats"), "source")
    return joined.groupBy("source").applyInPandas(_plan, "source string, size bigint, docs bigint, whole bigint, extra bigint, best boolean")


def short_sources(plan: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, taken, budget): sources whose plan takes every repetition that is allowed and still stays below the target."""
    taken = plan.groupBy("source").agg(F.sum(F.col("size") * (F.col("docs") * F.col("whole") + F.col("extra"))).alias("taken"), F.max("whole").alias("whole"))
    joined = budgets.join(taken, "source", "left")
    used_up = F.coalesce("whole", "max_repeats") >= F.col("max_repeats")
    return joined.where(used_up & (F.coalesce("taken", F.lit(0)) < F.col("target_share") * F.col("total"))).select("source", F.coalesce("taken", F.lit(0)).alias("taken"), "budget")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, repeats) of every selected document; ``sized`` has doc_id, source, size (tokens).

    Defined cases: documents of null or untargeted sources count in the total but are not
    selected; documents of size 0 are taken with their source's whole repetitions only; repeated
    rows are documents of their own; empty tables give no rows; other columns are ignored.
    """
    rows = cut(sized.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "size"))
    plan = cut(mix_plan(cut(length_counts(rows)), targets))
    hashed = rows.join(plan, ["source", "size"]).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    # whole buckets are below the wanted number; only the bucket on the border is ranked, so no large group is sorted in one task
    per = hashed.where("extra > 0 and extra < docs").groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    borders = per.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = hashed.join(borders, ["source", "size", "bucket"], "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    on_border = F.col("before").isNotNull() & (F.col("before") < F.col("extra")) & (F.col("before") + F.col("n") > F.col("extra"))
    border = placed.where(on_border).withColumn("more", F.when(F.col("before") + rank <= F.col("extra"), 1).otherwise(0))
    clear = placed.where(~F.coalesce(on_border, F.lit(False))).withColumn("more", F.when(F.col("extra") >= F.col("docs"), 1).when(F.col("before") + F.col("n") <= F.col("extra"), 1).otherwise(0))
    both = clear.select("doc_id", "source", "size", "whole", "more").unionByName(border.select("doc_id", "source", "size", "whole", "more"))
    return both.select("doc_id", "source", "size", (F.col("whole") + F.col("more")).alias("repeats")).where("repeats > 0")


def mix_report(selected: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, size, budget, taken, max_repeats, reachable); shares are of the total taken."""
    taken = selected.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"))
    everything = taken.agg(F.sum("taken").alias("all_taken"))
    joined = budgets.join(taken, "source", "left").join(F.broadcast(everything))  # a single row of totals
    share = F.coalesce("taken", F.lit(0)) / F.col("all_taken")
    return joined.select("source", "target_share", share.alias("actual_share"), "size", "budget", F.coalesce("taken", F.lit(0)).alias("taken"), "max_repeats", "reachable")
