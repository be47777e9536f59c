"""Fielded term queries such as ``confName:infovis AND NOT title:graph`` as a filter.

``field:term`` holds if the field's lower-cased words contain the term; for exact fields, if the
whole value equals it. ``*:*`` matches all. Terms without a field use the default field; terms
side by side mean OR. A clause after ``+`` must hold, one after ``-`` must not; the others then are optional.
AND, OR, NOT and brackets are understood.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(\(|\)|AND\b|OR\b|NOT\b|&&|\|\||!|\+|-|(?:[\w*]+:)?"[^"]*"|(?:[\w*]+:)?[^\s()]+)')


def parse_query(query: str, fields: dict[str, str], default: str, exact: frozenset[str] = frozenset()) -> Column:
    """Filter for ``query``; ``fields`` maps field names to columns, ``exact`` names those matched as a whole."""
    tokens = [t for t in _TOKEN.findall(query) if t.strip()]
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def any_of() -> Column:
        clauses: dict[str, list[Column]] = {"+": [], "-": [], "": []}
        while True:
            sign = take() if peek() in ("+", "-") else ""
            clauses[sign].append(all_of())
            if peek() in (None, ")"):
                break
            if peek() in ("OR", "||"):
                take()
        must = clauses["+"] or clauses[""]
        join = and_ if clauses["+"] else or_
        result = reduce(join, must) if must else F.lit(True)
        return reduce(and_, [~c for c in clauses["-"]], result)

    def all_of() -> Column:
        left = one()
        while peek() in ("AND", "&&"):
            take()
            left = left & one()
        return left

    def one() -> Column:
        token = take()
        if token in ("NOT", "!", "-"):
            return ~one()
        if token == "+":  # beside AND a clause must hold anyway
            return one()
        if token == "(":
            inside = any_of()
            if peek() != ")":
                raise ValueError(f"unbalanced bracket in {query!r}")
            take()
            return inside
        return term(token)

    def term(token: str) -> Column:
        field, colon, text = token.rpartition(":") if not token.startswith('"') else ("", "", token)
        if (field, text) == ("*", "*") or token == "*":
            return F.lit(True)
        field = field if colon else default
        if field not in fields:
            raise ValueError(f"unknown field {field!r}")
        column, text = F.col(fields[field]), text.strip('"')
        if field in exact:
            return F.coalesce(column == text, F.lit(False))
        words = re.findall(r"\w+", text.lower())
        have = F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
        phrase = F.contains(F.concat(F.lit(" "), F.array_join(have, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))
        return F.coalesce(phrase, F.lit(False))

    if not tokens:
        return F.lit(True)
    result = any_of()
    if peek() is not None:
        raise ValueError(f"unbalanced bracket in {query!r}")
    return result
