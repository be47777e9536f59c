"""From texts to tokens, vocabulary and term frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.plans.lineage import cut

ASCII_WORD, LETTERS = "([a-z]+)", r"(\p{L}+)"


def words(text: Column, pattern: str = ASCII_WORD) -> Column:
    """Lower-cased words in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def tokens(docs: DataFrame, text: str = "text", pattern: str = ASCII_WORD) -> DataFrame:
    """All other columns of ``docs`` with pos (from 0) and term; documents without words give no rows."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(words(F.col(text), pattern)).alias("pos", "term"))


def without_stop_words(toks: DataFrame, stop: DataFrame) -> DataFrame:
    """Anti-join on the term; ``stop`` has one lower-case word per row."""
    return toks.join(stop.select("term").distinct(), "term", "left_anti")


def term_frequencies(toks: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, n)."""
    return toks.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def vocabulary(tf: DataFrame, doc: str = "doc_id", min_tf: int = 2, max_tf: int = 10_000_000, min_df: int = 0) -> DataFrame:
    """(term, tf, df) of terms with min_tf < tf < max_tf and at least ``min_df`` documents."""
    counts = tf.where("n > 0").groupBy("term").agg(F.sum("n").alias("tf"), F.count(doc).alias("df"))
    return counts.where((F.col("tf") > min_tf) & (F.col("tf") < max_tf) & (F.col("df") >= min_df))


def dense_ids(rows: DataFrame, by: str, out: str = "w") -> DataFrame:
    """``rows`` with ids 0.. in the order of ``by``, which must be unique; no single task sees all rows.

    Ranges are ranked one by one; their sizes, one number per range, shift the ranks.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = cut(rows.repartitionByRange(n, by).withColumn("range_no", F.spark_partition_id()))
    sizes = {r["range_no"]: r["n"] for r in ranged.groupBy("range_no").agg(F.count("*").alias("n")).collect()}
    shift, before = {}, 0
    for k in sorted(sizes):
        shift[k], before = before, before + sizes[k]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]), F.col("range_no")) if shift else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("range_no").orderBy(by))
    return ranged.withColumn(out, (rank - 1 + offset).cast("bigint")).drop("range_no")


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs / df)


def sequences(toks: DataFrame, vocab: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, seq): ids of a document's terms in order; terms outside the vocabulary are left out."""
    coded = toks.join(vocab.select("term", "w"), "term")
    packed = coded.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("s"))
    return packed.select(doc, F.col("s.w").alias("seq"))


def sample_exact(rows: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Exactly floor(n * fraction) rows, by the order of a seeded hash of ``key``, which should tell rows apart.

    Rows fall into 4096 buckets by their hash; those below the border are taken whole and only the border's bucket is
    ranked, so that no task holds the sample.
    """
    hashed = rows.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("__bucket", F.substring("__hash", 1, 3))
    sizes = sorted((r["__bucket"], r["n"]) for r in hashed.groupBy("__bucket").agg(F.count("*").alias("n")).collect())
    wanted, border = int(sum(n for _, n in sizes) * fraction), None
    for border, n in sizes:
        if n > wanted:
            break
        wanted -= n
    else:
        return hashed.drop("__hash", "__bucket")
    whole = hashed.where(F.col("__bucket") < border)
    ranked = hashed.where(F.col("__bucket") == border).withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash", key)))
    return whole.unionByName(ranked.where(F.col("__rank") <= wanted).drop("__rank")).drop("__hash", "__bucket")


def folds(rows: DataFrame, k: int, key: str, seed: int | None = None) -> DataFrame:
    """``rows`` with a fold 0..k-1: by id if ``seed`` is None, else independently and uniformly at random."""
    fold = F.pmod(F.col(key), F.lit(k)) if seed is None else F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k))
    return rows.withColumn("fold", fold.cast("int"))


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` seeded rows of each group."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def sorted_frequencies(tf: DataFrame, max_vocab: int, doc: str = "doc_id") -> DataFrame:
    """(doc, terms, counts): a document's terms in order with their counts, of the ``max_vocab`` most frequent terms (ties by term)."""
    total = tf.groupBy("term").agg(F.sum("n").alias("total"))
    kept = total.orderBy(F.desc("total"), "term").limit(max_vocab).select("term")
    packed = tf.join(kept, "term").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("v"))
    return packed.select(doc, F.col("v.term").alias("terms"), F.col("v.n").alias("counts"))
