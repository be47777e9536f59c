"""Several values packed in one field: one row per value, with its position.

The field is split on quote characters. Odd pieces stand inside quotes and are literals;
only even pieces are split on delimiters. An empty even piece between two literals is a
doubled quote. Array functions put the pieces together again, so everything runs as SQL
expressions in the executors' JVM, in time linear in the field's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a delimiter while pieces are joined; three characters that no text has in this order.
BLANKS = " \t\r\n\f\u000b\u00a0\u2002\u2003\u2009\u3000"
HARD, SOFT = "\u0001\u0002\u0001", "\u0001\u0003\u0001"


@dataclass(frozen=True)
class Packing:
    """How a field packs its values.

    ``hard`` always separates; ``soft`` (if any) separates too, unless the parts around it
    form one value such as ``Last, First``. Both are regular expressions for the text
    outside quotes.
    """

    hard: str
    soft: str | None = None


#: Delimiters of keyword lists. A slash or dash counts only with blanks around it.
KEYWORDS = Packing(hard=r"[,;|·•\t\r\n]|(?:^|(?<=\s))(?:/|--|[–—])(?=\s|$)")
#: Delimiters of author lists.
AUTHORS = Packing(hard=r"[;|·•\t\r\n]|(?:^|(?<=\s))(?:/|&|and)(?=\s|$)", soft=r",")
#: Words that begin a family name.
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu")
_FAMILY = r"^(?:\S+|(?:(?i:" + "|".join(PARTICLES) + r")|v\.|d\.)\s+\S.*)$"
#: One word, or initials, or a given name with initials or a second name.
_GIVEN = r"^(?:\S+|\S+(?:\s+\S+){1,2})$"


def _pieces(field: Column) -> Column:
    """Pieces between quotes; where the number of quotes is odd the last one is an ordinary character."""
    parts = F.split(field, '"', -1)
    n = F.size(parts)
    last_two = F.concat(F.get(parts, n - 2), F.lit('"'), F.get(parts, n - 1))
    return F.when(n % 2 == 1, parts).otherwise(F.concat(F.slice(parts, 1, n - 2), F.array(last_two)))


def _marked(field: Column, packing: Packing) -> Column:
    """The field with marks for the delimiters outside quotes, the quotes still in place."""

    def mark(piece: Column, i: Column) -> Column:
        outside = F.regexp_replace(piece, packing.hard, HARD)
        if packing.soft:
            outside = F.regexp_replace(outside, packing.soft, SOFT)
        return F.when(i % 2 == 1, piece).otherwise(outside)

    return F.array_join(F.transform(_pieces(field), mark), '"')


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def _unwrap(c: Column) -> Column:
    """Without enclosing quotes, doubled inner quotes made single."""
    v = _trim(c)
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    # no regular expression over the whole value: its repeated groups would overflow the stack on long values
    wrapped = v.startswith('"') & v.endswith('"') & (F.length(v) > 1) & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))
    return F.when(wrapped, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(v)


def _nonempty(values: Column) -> Column:
    return F.filter(values, lambda v: _trim(v) != "")


def _join_names(parts: Column) -> Column:
    """Folds the parts between soft delimiters: a family name and the given name after it make one value."""
    start = F.struct(F.lit([]).cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(acc: Column, part: Column) -> Column:
        held, done = acc["held"], acc["done"]
        joins = held.isNotNull() & held.rlike(_FAMILY) & part.rlike(_GIVEN) & ~part.contains('"') & ~held.contains('"')
        return F.when(joins, F.struct(F.concat(done, F.array(F.concat(held, F.lit(", "), part))).alias("done"), F.lit(None).cast("string").alias("held"))).otherwise(
            F.struct(F.when(held.isNull(), done).otherwise(F.concat(done, F.array(held))).alias("done"), part.alias("held"))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))


def split_values(field: Column, packing: Packing) -> Column:
    """Array of the values of ``field`` in order; null for null, empty for a field without values."""
    hard = F.split(_marked(field, packing), HARD, -1)
    if not packing.soft:
        return _nonempty(F.transform(hard, _unwrap))

    def segment(s: Column) -> Column:
        parts = F.transform(_nonempty(F.split(s, SOFT, -1)), _trim)
        # the fold copies its result, so it runs only where something can join
        can_join = (F.size(parts) > 1) & F.exists(parts, lambda p: p.rlike(_FAMILY))
        return F.when(can_join, _join_names(parts)).otherwise(parts)

    return _nonempty(F.transform(F.flatten(F.transform(hard, segment)), _unwrap))


def latest_delivery(records: DataFrame, key: str, columns: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per key, of its last delivery; of equal deliveries the one with the greatest content.

    The hash aggregate pre-combines before the shuffle, so a key delivered very often is no hot group.
    """
    struct = F.struct(F.col(at), *[F.col(c) for c in columns])
    return records.groupBy(key).agg(F.max(struct).alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def explode_values(records: DataFrame, key: str, packings: dict[str, Packing]) -> DataFrame:
    """(key, field, pos, val): every value of the fields named in ``packings``.

    Defined cases: null and empty fields and empty values give no row; positions count from
    1 over the values that remain; repeated values stay; an unpaired quote is an ordinary
    character; repeated rows of ``records`` stay (see :func:`latest_delivery`).
    """
    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(split_values(F.col(f), p), F.array().cast(T.ArrayType(T.StringType()))).alias("vals")) for f, p in packings.items()])
    rows = records.select(F.col(key), F.explode(packed).alias("p"))
    return rows.select(key, "p.field", F.posexplode("p.vals").alias("pos0", "val")).select(key, "field", (F.col("pos0") + 1).alias("pos"), "val")
