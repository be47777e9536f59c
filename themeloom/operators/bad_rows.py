"""Separating rows that fail to parse from valid ones.

A table-driven finite-state machine reads the records. The records of an Arrow batch are
laid end to end and cut into equal chunks that ignore record borders. Each chunk first
yields its transition vector (the end state for every possible start state), computed
for all chunks at once; a parallel scan composes the vectors, which gives every chunk its
true start state; a second pass then knows the state before each character. A very long
record therefore costs no more per character than short ones, and its work is not serial.

The machine reports only positions (ends of fields or lines, first colons, the offset of a
quoting fault). Cutting out values and checking them stays in SQL expressions. Records are handed to the
machine in portions of a bounded number of characters; a longer record is a portion of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.plans.lineage import spread

#: The six fields of a record, in order.
FIELDS = ("year", "title", "link", "abstract", "keywords", "author")
YEAR_FROM, YEAR_TO = 1950, 2020

# character classes
OTHER, QUOTE, COMMA, LF, CR, COLON, BLANK, BEGIN_CSV, BEGIN_LABELLED = range(9)
# states: of comma-separated records, then of labelled ones
C_START, C_PLAIN, C_QUOTED, C_CLOSING, C_BROKEN, L_LABEL, L_BEFORE, L_PLAIN, L_QUOTED, L_CLOSED = range(10)
N_STATES, N_CLASSES, CHUNK = 10, 9, 128
#: Characters of one portion.
PORTION = 1 << 22


def _transitions() -> np.ndarray:
    t = np.zeros((N_STATES, N_CLASSES), np.uint8)
    t[C_START], t[C_PLAIN], t[C_QUOTED], t[C_CLOSING], t[C_BROKEN] = C_PLAIN, C_PLAIN, C_QUOTED, C_BROKEN, C_BROKEN
    t[C_START, QUOTE], t[C_START, COMMA] = C_QUOTED, C_START
    t[C_PLAIN, QUOTE], t[C_PLAIN, COMMA] = C_BROKEN, C_START
    t[C_QUOTED, QUOTE] = C_CLOSING
    t[C_CLOSING, QUOTE], t[C_CLOSING, COMMA] = C_QUOTED, C_START
    t[C_CLOSING, LF] = t[C_CLOSING, CR] = C_PLAIN
    t[L_LABEL], t[L_BEFORE], t[L_PLAIN], t[L_QUOTED], t[L_CLOSED] = L_LABEL, L_PLAIN, L_PLAIN, L_QUOTED, L_QUOTED
    t[L_LABEL, COLON] = L_BEFORE
    t[L_BEFORE, BLANK] = t[L_BEFORE, CR] = L_BEFORE
    t[L_BEFORE, QUOTE] = L_QUOTED
    t[L_QUOTED, QUOTE] = t[L_CLOSED, QUOTE] = L_CLOSED
    t[L_CLOSED, BLANK] = t[L_CLOSED, CR] = L_CLOSED
    t[L_LABEL:, LF] = L_LABEL
    t[:, BEGIN_CSV], t[:, BEGIN_LABELLED] = C_START, L_LABEL
    return t


TRANSITIONS = _transitions()
_CLASS_OF = np.zeros(129, np.uint8)
for _char, _class in (('"', QUOTE), (",", COMMA), ("\n", LF), ("\r", CR), (":", COLON), (" ", BLANK), ("\t", BLANK)):
    _CLASS_OF[ord(_char)] = _class


def states_before(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State of the machine before each character, by composing the chunks' transition vectors."""
    n = len(classes)
    parts = max(1, -(-n // chunk))
    grid = np.full(parts * chunk, BEGIN_CSV, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(parts, chunk).T)
    flat = TRANSITIONS.ravel()  # state * N_CLASSES + class stays below 256: no wider numbers are needed
    vector = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (parts, N_STATES))
    for row in grid:
        vector = flat[vector * np.uint8(N_CLASSES) + row[:, None]]
    step, scanned = 1, vector
    while step < parts:
        scanned = np.concatenate([scanned[:step], np.take_along_axis(scanned[step:], scanned[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[C_START], scanned[:-1, C_START]]).astype(np.uint8)
    before = np.empty((chunk, parts), np.uint8)
    for i, row in enumerate(grid):
        before[i] = state
        state = flat[state * np.uint8(N_CLASSES) + row]
    return before.T.ravel()[:n]


def tokenise(texts: list[str], is_csv: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of each record: (offsets, starts, ends, colons) in list layout, and per record
    the offset of the first quoting fault and of the first bare line break (-1: none)."""
    records = len(texts)
    lengths = np.fromiter((len(x) for x in texts), np.int64, records)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.concatenate([[0], np.cumsum(lengths + 1)])  # a mark stands before each record and after the last
    classes = np.zeros(int(marks[-1]) + 1, np.uint8)
    text_at = np.ones(len(classes), bool)
    text_at[marks] = False
    classes[text_at] = _CLASS_OF[np.minimum(codes, 128)]
    classes[marks[:-1]] = np.where(is_csv, BEGIN_CSV, BEGIN_LABELLED)
    classes[marks[-1]] = BEGIN_CSV
    before = states_before(classes)
    is_mark = ~text_at
    labelled = before >= L_LABEL
    open_csv = (before == C_START) | (before == C_PLAIN) | (before == C_CLOSING)
    breaks = np.flatnonzero(is_mark | (open_csv & (classes == COMMA)) | (labelled & (classes == LF)))
    starts, ends = breaks[:-1] + 1, breaks[1:]
    record = np.searchsorted(marks, breaks[:-1], "right") - 1
    colons = np.full(len(starts), -1, np.int64)
    colon_at = np.flatnonzero((before == L_LABEL) & (classes == COLON))
    colons[np.searchsorted(breaks, colon_at) - 1] = colon_at
    base = marks[record] + 1
    after = TRANSITIONS[before, classes]
    fault = ((after == C_BROKEN) & (before != C_BROKEN)) | (is_mark & ((before == C_QUOTED) | (before == L_QUOTED)))
    fault |= (before == L_QUOTED) & (classes == LF)
    fault[0] = False
    bare = open_csv & ((classes == LF) | (classes == CR)) & text_at

    def first(flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        out = np.full(records, -1, np.int64)
        who = np.searchsorted(marks, at, "left") - 1  # a mark belongs to the record that it ends
        out[who[::-1]] = (at - marks[who] - 1)[::-1]
        return out

    offsets = np.concatenate([[0], np.cumsum(np.bincount(record, minlength=records))])
    return offsets, starts - base, ends - base, np.where(colons < 0, -1, colons - base), first(fault), first(bare)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``PORTION`` characters, or one record."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("raw")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PORTION, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _portions(batches):
        is_csv = np.array([x == "csv" for x in batch.column("layout").to_pylist()])
        # line breaks that end a comma-separated record end it and are no content
        texts = [(x or "").rstrip("\r\n") if c else (x or "") for x, c in zip(batch.column("raw").to_pylist(), is_csv)]
        offsets, starts, ends, colons, fault, bare = tokenise(texts, is_csv)
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (starts, ends, colons)]
        columns = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*columns, *lists, pa.array(fault, pa.int32()), pa.array(bare, pa.int32())],
            names=[*batch.schema.names, "starts", "ends", "colons", "fault", "bare"],
        )


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\r\n"))


def _letters(c: Column) -> Column:
    """At least one letter, neither U+FFFD nor control characters but tab and line breaks."""
    return F.coalesce(c.rlike(r"\p{L}") & ~c.rlike(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), F.lit(False))


def parse_records(raw: DataFrame) -> DataFrame:
    """One row per input record: its typed fields, or the reason and offset of its fault.

    ``raw`` needs raw_id, file_name, layout (``csv`` or ``labelled``), raw and loaded_at; other
    columns are ignored. Result: raw_id, file_name, raw, loaded_at, year, title, link, uri, abstract, keywords,
    author, conf_name, reason (null: valid) and fault_at, the character offset of the fault: of the broken quote, of
    the first field or line that is surplus, mislabelled or out of order (the record's end if one is missing), or of the invalid value.

    Defined cases: a null or empty record, and a null or unknown layout, have the reason
    ``columns``; a bare line break inside a comma-separated record gives ``columns``, line
    breaks at its end are ignored; repeated rows stay repeated; an empty table gives none.
    """
    needed = raw.select("raw_id", "file_name", "layout", "raw", "loaded_at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema.fields)
    scanned = spread(needed).mapInArrow(_scan, f"{schema}, starts array<int>, ends array<int>, colons array<int>, fault int, bare int")
    part = lambda s, e: F.substring(F.col("raw"), s + 1, e - s)
    spans = F.arrays_zip("starts", "ends", "colons")
    csv_values = F.transform(
        spans,
        lambda x: F.when(part(x["starts"], x["starts"] + 1) == '"', F.replace(part(x["starts"] + 1, x["ends"] - 1), F.lit('""'), F.lit('"'))).otherwise(part(x["starts"], x["ends"])),
    )
    labels = F.transform(spans, lambda x: F.when(x["colons"] >= 0, F.lower(_trim(part(x["starts"], x["colons"])))))
    values = F.transform(spans, lambda x: F.when(x["colons"] >= 0, _trim(part(x["colons"] + 1, x["ends"]))).otherwise(_trim(part(x["starts"], x["ends"]))))
    lines = scanned.withColumns(
        {
            "labels": F.when(F.col("layout") == "labelled", labels),
            "values": F.when(F.col("layout") == "csv", csv_values).otherwise(values),
        }
    )
    n = F.size("values")
    expected = F.array(*[F.lit(x) for x in FIELDS])
    trailing = (n <= 6) | (
        (F.get("colons", F.lit(6)) < 0) & ((n <= 7) | F.forall(F.slice("values", 8, F.greatest(n, F.lit(8))), lambda v: v == ""))
    )
    in_order = F.coalesce(F.when(n >= 6, (F.slice("labels", 1, 6) == expected) & trailing), F.lit(False))
    shape_ok = F.when(F.col("raw").isNull() | (F.col("raw") == ""), F.lit(False)).when(F.col("layout") == "csv", (n == 6) & (F.col("bare") < 0)).when(F.col("layout") == "labelled", in_order).otherwise(F.lit(False))
    value = {name: F.get("values", F.lit(i)) for i, name in enumerate(FIELDS)}
    year = F.trim(value["year"], F.lit(" \t\r\n"))
    year_ok = F.coalesce(year.rlike(r"^[0-9]{4}\z") & year.try_cast("int").between(YEAR_FROM, YEAR_TO), F.lit(False))
    known = F.coalesce(F.col("layout").isin("csv", "labelled"), F.lit(False))
    reason = (
        F.when(known & (F.col("fault") >= 0), "quoting")
        .when(~shape_ok, "columns")
        .when(~year_ok, "year")
        .when(~_letters(value["title"]), "title")
        .when(~_letters(value["abstract"]), "abstract")
        .when(~_letters(value["author"]), "author")
    )
    end = F.coalesce(F.length("raw"), F.lit(0))
    # the first of the six lines whose label is wrong, else the first one after them that may not be there
    wrong = [F.when(~F.coalesce(F.get("labels", F.lit(i)) == name, F.lit(False)), F.get("starts", F.lit(i))) for i, name in enumerate(FIELDS)]
    rows_after = F.slice(F.zip_with("starts", "values", lambda s, v: F.struct(s.alias("s"), v.alias("v"))), 8, F.greatest(n, F.lit(8)))
    surplus = F.when(F.get("colons", F.lit(6)) >= 0, F.get("starts", F.lit(6))).otherwise(F.get(F.filter(rows_after, lambda x: x["v"] != ""), F.lit(0))["s"])
    shape_at = F.when(F.col("layout") == "csv", F.when(F.col("bare") >= 0, F.col("bare")).when(n > 6, F.get("starts", F.lit(6)))).when(F.col("layout") == "labelled", F.coalesce(*wrong, surplus)).otherwise(F.lit(0))
    value_at = lambda i: F.when(F.get("colons", F.lit(i)) >= 0, F.get("colons", F.lit(i)) + 1).otherwise(F.get("starts", F.lit(i)))
    fault_at = F.when(reason == "quoting", F.col("fault")).when(reason == "columns", F.least(F.coalesce(shape_at, end), end))
    for i, name in enumerate(FIELDS):
        fault_at = fault_at.when(reason == name, value_at(i))
    link_line = F.when(F.col("layout") == "csv", F.concat(F.lit("link: "), value["link"])).otherwise(
        F.rtrim(part(F.get("starts", F.lit(2)), F.get("ends", F.lit(2))))
    )
    uri = F.concat(F.array_join(F.transform(F.split(value["link"], ":", -1), lambda p: F.trim(p)), "_"), F.lit("_"))
    return lines.select(
        "raw_id",
        "file_name",
        "raw",
        "loaded_at",
        year.alias("year"),
        value["title"].alias("title"),
        link_line.alias("link"),
        uri.alias("uri"),
        value["abstract"].alias("abstract"),
        value["keywords"].alias("keywords"),
        value["author"].alias("author"),
        F.regexp_extract("file_name", r"^([^_.]+)", 1).alias("conf_name"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), fault_at).alias("fault_at"),
    )


def valid_records(raw: DataFrame, typed: bool = False) -> DataFrame:
    """The valid records as columns of bib_records; raw_id becomes rec_id. ``typed``: year as a number instead of the source's string."""
    good = parse_records(raw).where(F.col("reason").isNull())
    if typed:
        good = good.withColumn("year", F.col("year").cast("int"))
    return good.select(F.col("raw_id").alias("rec_id"), *FIELDS[:3], "uri", *FIELDS[3:], "conf_name", "loaded_at")


def rejected_records(raw: DataFrame) -> DataFrame:
    """The faulty records with raw_id, file_name, reason, fault_at and the record itself."""
    return parse_records(raw).where(F.col("reason").isNotNull()).select("raw_id", "file_name", "reason", "fault_at", "raw")
