"""Sources and sinks: labelled text records, an index as a table, stop words, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.search import parse_query
from themeloom.functions import text
from themeloom.functions.text import sample_exact
from themeloom.operators import timeline
from themeloom.plans.lineage import cut

FIELDS = ("year", "title", "link", "abstract", "keywords", "author")


@dataclass(frozen=True)
class CorpusSchema:
    """Names of the columns that hold a document's parts; ``scale`` is month or year."""

    uri: str = "uri"
    title: str = "title"
    body: str = "abstract"
    corpus: str = "conf_name"
    time: str = "year"
    scale: str = "month"


def split_records(lines: DataFrame, corpus: str | Column, lines_per_record: int = 7) -> DataFrame:
    """Records of ``lines`` (file, pos, value), which counts lines: six labelled ones and a separator.

    Values are what follows the first colon; ``link`` keeps the whole line and ``uri`` joins its pieces. ``mislabelled`` counts
    lines whose label is not the expected one.
    """
    at = F.pmod("pos", F.lit(lines_per_record))
    labelled = lines.where(at < 6).withColumns({"record": F.floor(F.col("pos") / lines_per_record), "i": at})
    label = F.lower(F.trim(F.substring_index("value", ":", 1)))
    value = F.when(F.instr("value", ":") > 0, F.trim(F.expr("substring(value, instr(value, ':') + 1)")))
    expected = F.element_at(F.array(*[F.lit(x) for x in FIELDS]), (F.col("i") + 1).cast("int"))
    wide = labelled.groupBy("file", "record").agg(
        *[F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(FIELDS)],
        F.max(F.when(F.col("i") == 2, F.rtrim("value"))).alias("link_line"),
        F.count_if(label != expected).alias("mislabelled"),
    )
    uri = F.concat(F.array_join(F.transform(F.split("link", ":"), lambda p: F.trim(p)), "_"), F.lit("_"))
    name = F.lit(corpus) if isinstance(corpus, str) else corpus
    return wide.select("file", "record", "year", "title", F.col("link_line").alias("link"), uri.alias("uri"), "abstract", "keywords", "author", name.alias("conf_name"), "mislabelled")


def read_labelled(spark: SparkSession, paths: str | list[str], corpus: str) -> DataFrame:
    """Labelled records of text files; records are counted per file."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return split_records(lines, corpus).where(F.col("title").isNotNull())


def write_index(records: DataFrame, path: str, create: bool, partition: str = "conf_name") -> None:
    """``create`` replaces the index, otherwise records are appended."""
    records.write.mode("overwrite" if create else "append").partitionBy(partition).parquet(path)


def load_index(spark: SparkSession, path: str, query: str, schema: CorpusSchema = CorpusSchema(), fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """(uri, text, corpus, time) of the records a fielded query finds, or a seeded exact share of them."""
    rows = spark.read.parquet(path)
    names = {c: c for c in rows.columns} | {"confName": schema.corpus}
    hits = rows.where(parse_query(query, names, schema.title, frozenset({"uri", "link"})))
    docs = hits.select(F.col(schema.uri).alias("uri"), F.concat(F.coalesce(schema.title, F.lit("")), F.coalesce(schema.body, F.lit(""))).alias("text"), F.col(schema.corpus).alias("corpus"), F.col(schema.time).alias("time"))
    return docs if fraction >= 1 else sample_exact(docs, fraction, "uri", seed)


def from_lists(spark: SparkSession, uris: list, contents: list, times: list, corpora: list) -> DataFrame:
    """(uri, text, corpus, time) from parallel lists; time in epoch milliseconds."""
    if not len(uris) == len(contents) == len(times) == len(corpora):
        raise ValueError("lists differ in length")
    return spark.createDataFrame(list(zip(uris, contents, corpora, times)), "uri string, text string, corpus string, time bigint")


def prepare(docs: DataFrame, bucket: Column, scale: str = "month", stop: DataFrame | None = None, min_tf: int = 2, max_tf: int = 10_000_000) -> dict[str, DataFrame]:
    """From (uri, text, corpus, time) to the model's tables: ``docs`` (uri, corpus, time_idx), ``times``, ``vocab`` (term, tf, df) and ``tf`` (uri, term, n).

    ``bucket`` is the slice of a document as a Column over ``docs``; documents without one have no time_idx.
    """
    tokens = text.tokens(docs.select("uri", "text"))
    counted = cut(text.term_frequencies(tokens if stop is None else text.without_stop_words(tokens, stop), "uri"))
    vocab = text.vocabulary(counted, "uri", min_tf, max_tf)
    times = timeline.spine(docs, bucket, scale)
    placed = docs.withColumn("bucket", bucket).join(times.select("bucket", "time_idx"), "bucket", "left")
    return {"docs": placed.select("uri", "corpus", "time_idx"), "times": times, "vocab": vocab, "tf": counted.join(vocab.select("term"), "term")}


def load_corpora(spark: SparkSession, path: str, query: str, fraction: float = 1.0, seed: int = 0, schema: CorpusSchema = CorpusSchema(), stop: DataFrame | None = None) -> dict[str, DataFrame]:
    """From an index to the model's tables: the records a query finds, or a seeded share of them (see :func:`prepare`)."""
    docs = load_index(spark, path, query, schema, fraction, seed)
    return prepare(docs, timeline.year_bucket(F.col("time").try_cast("int"), "year"), "year", stop)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): one lower-case word per line, without byte-order mark and carriage return, each once."""
    word = F.trim(F.regexp_replace(F.lower("value"), "[﻿\r]", ""))
    return spark.read.text(path).select(word.alias("term")).where("term <> ''").distinct()


def write_report(report: DataFrame, path: str | None, partition: str = "time_idx") -> None:
    """Appends a report, one folder per slice; no path, no files."""
    if path is not None:
        report.write.mode("append").partitionBy(partition).json(path)
