"""Queries over faulty rows and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import bad_rows, multivalue


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.rejected_records(_table(spark, d, "bib_raw")).select("raw_id", "reason").distinct()


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.valid_records(_table(spark, d, "bib_raw")).select("rec_id", "year", "title", "abstract", "keywords", "author", "conf_name")


def p1_typed(spark: SparkSession, d: str) -> DataFrame:
    good = bad_rows.valid_records(_table(spark, d, "bib_raw"), typed=True)
    return good.groupBy("year", "conf_name").agg(F.count("*").alias("records"), F.sum(F.length("title")).alias("title_chars"))


def p1_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Faulty records with the offset of their fault and the text from there."""
    bad = bad_rows.rejected_records(_table(spark, d, "bib_raw"))
    return bad.select("raw_id", "reason", "fault_at", F.expr("substring(raw, fault_at + 1, 20)").alias("from_there"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    parsed = bad_rows.parse_records(_table(spark, d, "bib_raw"))
    return parsed.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def packed_values(spark: SparkSession, d: str) -> DataFrame:
    latest = multivalue.latest_delivery(_table(spark, d, "bib_records"), "rec_id", ["keywords", "author"])
    return multivalue.explode_values(latest, "rec_id", {"keywords": multivalue.KEYWORDS, "author": multivalue.AUTHORS})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(spark, d)


QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p1_typed": p1_typed, "p1_offsets": p1_offsets, "p1_reasons": p1_reasons, "p3_found": p3_found}

#: Quotes mask commas: even pieces between quotes have theirs replaced by a mark.
_P1 = r"""
WITH c AS (SELECT raw_id, regexp_replace(raw, '[\r\n]+$', '') AS r FROM bib_raw WHERE layout = 'csv'),
cf AS (SELECT raw_id, r, string_split(array_to_string(list_transform(string_split(r, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, ',', chr(1)) ELSE x END), '"'), chr(1)) AS f FROM c),
csv_rows AS (SELECT raw_id,
    NOT regexp_full_match(r, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS bad_quotes,
    len(f) <> 6 AS bad_shape,
    list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM cf),
l AS (SELECT raw_id, list_transform(string_split(replace(raw, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))) AS f FROM bib_raw WHERE layout = 'labelled'),
lv AS (SELECT raw_id, f, list_transform(f, lambda x: CASE WHEN contains(x, ':') THEN trim(x[strpos(x, ':') + 1:], chr(32) || chr(9)) ELSE x END) AS v,
    list_transform(f, lambda x: CASE WHEN contains(x, ':') THEN lower(trim(split_part(x, ':', 1), chr(32) || chr(9))) ELSE '-' END) AS k FROM l),
labelled_rows AS (SELECT raw_id,
    len(list_filter(list_zip(f, v), lambda z: contains(z[1], ':') AND z[2][1] = '"' AND (length(z[2]) = 1 OR z[2][-1] <> '"'))) > 0 AS bad_quotes,
    k[1:6] <> ['year', 'title', 'link', 'abstract', 'keywords', 'author'] OR (len(f) > 6 AND (contains(f[7], ':') OR array_to_string(f[8:], '') <> '')) AS bad_shape,
    v FROM lv),
every_row AS (SELECT * FROM csv_rows UNION ALL SELECT * FROM labelled_rows),
judged AS (SELECT raw_id, CASE WHEN bad_quotes THEN 'quoting' WHEN bad_shape THEN 'columns'
    WHEN NOT regexp_full_match(trim(v[1], chr(32) || chr(9)), '19[5-9][0-9]|20[01][0-9]|2020') THEN 'year'
    WHEN NOT regexp_matches(v[2], '\p{L}') OR regexp_matches(v[2], '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]') THEN 'title'
    WHEN NOT regexp_matches(v[4], '\p{L}') OR regexp_matches(v[4], '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]') THEN 'abstract'
    WHEN NOT regexp_matches(v[6], '\p{L}') OR regexp_matches(v[6], '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]') THEN 'author' END AS reason FROM every_row)
"""
_P1_VALID = _P1 + r"""
, good AS (SELECT b.raw_id AS rec_id, trim(e.v[1], chr(32) || chr(9)) AS year, e.v[2] AS title, e.v[4] AS abstract, e.v[5] AS keywords, e.v[6] AS author, regexp_extract(file_name, '^([^_.]+)', 1) AS conf_name
  FROM bib_raw b JOIN every_row e ON e.raw_id = b.raw_id JOIN judged j ON j.raw_id = b.raw_id WHERE j.reason IS NULL)
"""
_FAMILY_SQL = r"^(?:\S+|(?:(?i:van|von|de|del|della|der|den|di|da|dos|du|la|le|ten|ter|zu)|v\.|d\.)\s+\S.*)$"
#: Values of packed fields: hard delimiters become chr(1), commas between names chr(2), outside quotes only.
PACKED_SQL = rf"""
once AS (SELECT rec_id, max_by(keywords, loaded_at) AS keywords, max_by(author, loaded_at) AS author FROM bib_records GROUP BY rec_id),
fields AS (SELECT rec_id, 'keywords' AS field, string_split(keywords, '"') AS q FROM once WHERE keywords IS NOT NULL UNION ALL SELECT rec_id, 'author', string_split(author, '"') FROM once WHERE author IS NOT NULL),
masked AS (SELECT rec_id, field, array_to_string(list_transform(q, lambda x, i: CASE WHEN i % 2 = 0 THEN x
    WHEN field = 'keywords' THEN regexp_replace(regexp_replace(x, '(^|\s)(/|--|–|—)(\s|$)', chr(1), 'g'), '[,;|·•\t\r\n]', chr(1), 'g')
    ELSE replace(regexp_replace(regexp_replace(x, '(^|\s)(/|&|and)(\s|$)', chr(1), 'g'), '[;|·•\t\r\n]', chr(1), 'g'), ',', chr(2)) END), '"') AS m FROM fields),
segments AS (SELECT rec_id, field, unnest(string_split(m, chr(1))) AS s, unnest(range(len(string_split(m, chr(1))))) AS i FROM masked),
parts AS (SELECT rec_id, field, i, list_filter(list_transform(string_split(s, chr(2)), lambda x: trim(x)), lambda x: x <> '') AS p FROM segments),
joined AS (SELECT rec_id, field, i, CASE WHEN len(p) = 2 AND regexp_matches(p[1], '{_FAMILY_SQL}') AND regexp_matches(p[2], '^\S+(\s+\S+){{0,2}}$') AND NOT contains(p[1] || p[2], '"') THEN [p[1] || ', ' || p[2]] ELSE p END AS p FROM parts),
flat AS (SELECT rec_id, field, i, unnest(p) AS x, unnest(range(len(p))) AS j FROM joined),
clean AS (SELECT rec_id, field, i, j, CASE WHEN length(x) > 1 AND x[1] = '"' AND x[-1] = '"' AND NOT contains(replace(x[2:-2], '""', ''), '"') THEN replace(x[2:-2], '""', '"') ELSE x END AS val FROM flat),
packed AS (SELECT rec_id, field, CAST(row_number() OVER (PARTITION BY rec_id, field ORDER BY i, j) AS INTEGER) AS pos, val FROM clean WHERE trim(val) <> '')
"""
ORACLE: dict[str, str] = {
    "p1_found": _P1 + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_valid": _P1_VALID + "SELECT rec_id, year, title, abstract, keywords, author, conf_name FROM good",
    "p1_typed": _P1_VALID + "SELECT CAST(year AS INTEGER) AS year, conf_name, count(*) AS records, CAST(sum(length(title)) AS BIGINT) AS title_chars FROM good GROUP BY ALL",
    "p1_reasons": _P1 + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY ALL",
    "p3_found": f"WITH {PACKED_SQL} SELECT rec_id, field, pos, val FROM packed",
}
