"""Queries over training-data problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import cooccurrence, leaks, mixing, names, subjects, terms, truncation
from themeloom.operators import multivalue
from themeloom.operators.queries import PACKED_SQL
from themeloom.plans.lineage import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Path of a tokenizer file: the folder is the setting ``spark.themeloom.tokenizers``."""
    return f"{spark.conf.get('spark.themeloom.tokenizers', '/opt/tokenizers')}/{name}"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.link_names(_table(spark, d, "author_names")))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_table(spark, d, "author_names"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.cluster_documents(_table(spark, d, "tf")).select("doc_id", "rep_id")


def p4_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.describe_clusters(_table(spark, d, "tf"))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    latest = multivalue.latest_delivery(_table(spark, d, "bib_records"), "rec_id", ["keywords"])
    values = multivalue.explode_values(latest, "rec_id", {"keywords": multivalue.KEYWORDS})
    return values.select("rec_id", F.lower("val").alias("kw"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = cooccurrence.pair_lift(_baskets(spark, d), "rec_id", "kw", min_together=5, min_lift=4.0)
    return found.select(F.col("item_a").alias("kw_a"), F.col("item_b").alias("kw_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("kw_a", "kw_b")


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.latest_delivery(_table(spark, d, "bib_records"), "rec_id", ["abstract"]).where(F.col("abstract").isNotNull())


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    tf, vocab = _table(spark, d, "tf"), _table(spark, d, "vocab")
    docs = tf.where(F.col("n") > 0).agg(F.count_distinct("doc_id").alias("n_records"))
    by_w = terms.vector_counts(tf).join(vocab.select(F.col("w").cast("bigint").alias("w"), "term"), "w")
    records = _table(spark, d, "bib_records").where(F.col("abstract").isNotNull()).agg(F.count_distinct("rec_id").alias("n_records"))
    words = terms.ngram_counts(_abstracts(spark, d), "abstract", max_n=1, depth=4)
    parts = []
    for field, counts, n in (("tf", by_w, docs), ("abstract", words, records)):
        both = counts.join(F.broadcast(n))  # a single row
        parts.append(both.select(F.lit(field).alias("field"), "term", "total", "records", terms.mark(F.col("total"), F.col("records"), F.col("n_records")).alias("mark")))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequencies(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p6_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return terms.repeated_ngrams(_abstracts(spark, d), "rec_id", "abstract", min_n=2)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "source", mixing.pieces(F.col("text")).alias("size"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    counts, targets = cut(mixing.length_counts(_pieces(spark, d))), _table(spark, d, "mix_targets")
    return mixing.short_sources(mixing.mix_plan(counts, targets), mixing.source_budgets(counts, targets)).select("source")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Per source its size in whitespace-separated pieces, its budget, the most that is allowed of it, and whether the plan fits: it
    takes no more than that, and no document that it leaves out would fit into what remains."""
    counts, targets = cut(mixing.length_counts(_pieces(spark, d))), _table(spark, d, "mix_targets")
    plan = mixing.mix_plan(counts, targets)
    taken = plan.groupBy("source").agg(F.sum(F.col("size") * (F.col("docs") * F.col("whole") + F.col("extra"))).alias("taken"))
    shortest = plan.where("size > 0 AND extra < docs").groupBy("source").agg(F.min("size").alias("shortest"))
    budgets = mixing.source_budgets(counts, targets).select("source", "budget", "size", F.least("budget", F.col("max_repeats") * F.col("size")).alias("allowed"))
    left = F.col("allowed") - F.coalesce("taken", F.lit(0))
    return budgets.join(taken, "source", "left").join(shortest, "source", "left").select("source", "size", "budget", "allowed", ((left == 0) | (left > 0) & (left < F.coalesce("shortest", left + 1))).alias("fits"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return mixing.token_counts(_table(spark, d, "documents").select("doc_id", "source", "text"), "text", _tokenizer(spark))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_tokens(spark, d), _table(spark, d, "mix_targets"), seed=7)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(_tokens(spark, d))
    targets = _table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix(sized, targets, seed=7), mixing.source_budgets(mixing.length_counts(sized), targets))


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(_table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_judged(spark, d).where("truncated").select("doc_id").distinct()


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    found = truncation.truncation_by_source(p9_judged(spark, d))
    return found.withColumn("rate", F.round("rate", 6))


QUERIES = {f.__name__: f for f in (p2_found, p2_entities, p4_found, p4_subjects, p5_found, p5_pairs, p6_found, p6_frequencies, p6_ngrams, p7_found, p8_found, p8_pieces, p8_selection, p8_shares, p9_found, p9_judged, p9_by_source)}

_ABSTRACT_WORDS = """
once AS (SELECT rec_id, max_by(abstract, loaded_at) AS abstract FROM bib_records WHERE abstract IS NOT NULL GROUP BY rec_id),
words AS (SELECT rec_id, unnest(regexp_extract_all(lower(abstract), '[a-z]+')) AS term FROM once)"""
_TF_ONCE = "tf_once AS (SELECT doc_id, w, max(n) AS n FROM tf WHERE n > 0 GROUP BY doc_id, w)"
_P6 = f"""
WITH {_TF_ONCE}, {_ABSTRACT_WORDS},
counts AS (
  SELECT 'tf' AS field, v.term, CAST(sum(t.n) AS BIGINT) AS total, count(*) AS records, (SELECT count(DISTINCT doc_id) FROM tf_once) AS n_records
  FROM tf_once t JOIN vocab v ON v.w = t.w GROUP BY v.term
  UNION ALL
  SELECT 'abstract', term, count(*), count(DISTINCT rec_id), (SELECT count(*) FROM once) FROM words GROUP BY term),
marked AS (SELECT field, term, total, records, CASE WHEN total <= 2 THEN 'rare' WHEN records > n_records * 0.5 THEN 'common' END AS mark FROM counts)
"""
_SIZES = """
WITH sized AS (SELECT source, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS size FROM documents),
per AS (SELECT source, sum(size) AS size FROM sized GROUP BY source), total AS (SELECT sum(size) AS total FROM sized)
"""

_P5 = f"""
WITH {PACKED_SQL}, b AS (SELECT DISTINCT rec_id, lower(val) AS kw FROM packed WHERE field = 'keywords'), one AS (SELECT kw, count(*) AS n FROM b GROUP BY kw),
two AS (SELECT x.kw AS kw_a, y.kw AS kw_b, count(*) AS n_ab FROM b x JOIN b y ON x.rec_id = y.rec_id AND x.kw < y.kw GROUP BY x.kw, y.kw),
lifted AS (SELECT kw_a, kw_b, a.n AS n_a, c.n AS n_b, n_ab, round(n_ab * (SELECT count(DISTINCT rec_id) FROM b) / (a.n * c.n), 6) AS lift
  FROM two JOIN one a ON a.kw = kw_a JOIN one c ON c.kw = kw_b WHERE n_ab >= 5 AND n_ab * (SELECT count(DISTINCT rec_id) FROM b) >= 4 * a.n * c.n)
"""

ORACLE = {
    "p5_pairs": _P5 + "SELECT * FROM lifted",
    "p5_found": _P5 + "SELECT kw_a, kw_b FROM lifted",
    "p6_found": _P6 + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    # 24 words: longer than any repeat in abstracts; a longer one would show as a difference
    "p6_ngrams": f"""WITH {_ABSTRACT_WORDS}, lists AS (SELECT rec_id, regexp_extract_all(lower(abstract), '[a-z]+') AS x FROM once),
grams AS (SELECT rec_id, n AS length, unnest(list_transform(range(1, len(x) - n + 2), lambda i: array_to_string(x[i:i + n - 1], ' '))) AS term FROM lists, range(2, 25) t(n) WHERE len(x) >= n)
SELECT CAST(length AS INTEGER) AS length, term, count(*) AS total, count(DISTINCT rec_id) AS records FROM grams GROUP BY ALL HAVING count(*) > 1""",
    "p6_frequencies": _P6 + "SELECT * FROM marked",
    "p8_pieces": _SIZES + """, t AS (SELECT m.source, CAST(coalesce(p.size, 0) AS BIGINT) AS size, CAST(round(m.target_share * total) AS BIGINT) AS budget, m.max_repeats FROM mix_targets m LEFT JOIN per p ON p.source = m.source, total)
SELECT source, size, budget, CAST(least(budget, max_repeats * size) AS BIGINT) AS allowed, true AS fits FROM t""",
    "p8_found": _SIZES + "SELECT m.source FROM mix_targets m LEFT JOIN per p ON p.source = m.source, total WHERE m.max_repeats * coalesce(p.size, 0) < m.target_share * total",
}
