"""Frequency of every n-gram by suffix arrays with common-prefix intervals.

Records never cross blocks, so each block of records gets its own suffix array and both
counts add up over blocks: the occurrences of an n-gram are the length of its interval of
equal prefixes; its records are that length less the duplicate adjacencies, that is the
suffixes whose predecessor of the same record lies in the same interval. What is shuffled
is one row per block and n-gram. N-grams longer than the arrays are sorted to are followed from one length to
the next where they repeat, up to the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.plans.lineage import cut, spread

BLOCK_TOKENS = 1 << 20


def suffix_array(tokens: np.ndarray, record: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens, then by record; and the length of the
    common prefix of each suffix with the one before it, at most ``depth``.

    Suffixes end with their record; positions of one record are neighbours. Prefix doubling.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(record, record, "right")
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width, ranks = 1, [(1, rank)]
    while width < depth:
        at = np.arange(n) + width
        second = np.where(at < ends, rank[np.minimum(at, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
        ranks.append((width, rank))
    order = np.lexsort((record, rank))
    # common prefix with the suffix before: largest power first, as ranks of each width are equal or not
    a, b = order[1:].copy(), order[:-1].copy()
    common = np.zeros(n - 1, np.int64)
    for step, r in reversed(ranks):
        inside = (a + common < ends[a]) & (b + common < ends[b])
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        whole = (a + common + step <= ends[a]) & (b + common + step <= ends[b])
        common += np.where(inside & whole & (r[x] == r[y]), step, 0)
    return order, np.concatenate([[0], np.minimum(common, depth)])


def intervals(order: np.ndarray, common: np.ndarray, record: np.ndarray, n: int, length: int, weight: np.ndarray | None = None):
    """(first position, occurrences, records) of each n-gram of ``length`` in a suffix array."""
    ends = np.searchsorted(record, record, "right")
    long_enough = order + length <= ends[order]
    kept = np.flatnonzero(long_enough)
    if not len(kept):
        return (np.zeros(0, np.int64),) * 3
    # prefixes between two kept suffixes are the minimum of the common prefixes passed over; a shorter
    # suffix sorts before all that extend it, so nothing of the same n-gram is skipped over
    opens = common[kept] < length
    opens[0] = True
    start = np.flatnonzero(opens)
    of = record[order[kept]]
    by_record = np.argsort(of, kind="stable")
    previous = np.full(len(kept), -1, np.int64)  # the suffix before it that is of the same record
    again = of[by_record[1:]] == of[by_record[:-1]]
    previous[by_record[1:][again]] = by_record[:-1][again]
    same = (previous >= start[np.cumsum(opens) - 1]).astype(np.int64)
    w = np.ones(len(kept), np.int64) if weight is None else weight[order[kept]]
    occurrences = np.add.reduceat(w, start)
    records = np.diff(np.append(start, len(kept))) - np.add.reduceat(same, start)
    return order[kept[start]], occurrences, records


def _count(depth: int, lengths: tuple[int, ...], pattern: str, lower: bool):
    def emit(words: pa.Array, codes: np.ndarray, record: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, common = suffix_array(codes, record, depth)
        for length in lengths:
            first, occurrences, records = intervals(order, common, record, len(codes), length)
            if len(first):
                parts = [words.take(pa.array(codes[first + i])) for i in range(length)]
                gram = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), length, np.int32)), gram, pa.array(occurrences), pa.array(records)], names=["length", "term", "total", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        held: list[list[str]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            record = np.repeat(np.arange(len(held)), [len(x) for x in held])
            coded = pa.array([w for x in held for w in x], pa.string()).dictionary_encode()
            if len(record):
                yield from emit(coded.dictionary, coded.indices.to_numpy().astype(np.int64), record)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    found = find(text.lower() if lower else text)
                    held.append(found)
                    size += len(found)
                    if size >= BLOCK_TOKENS:
                        yield from flush()
                        held, size = [], 0
        yield from flush()

    return run


def ngram_counts(texts: DataFrame, text: str, max_n: int = 1, min_n: int = 1, pattern: str = "[a-z]+", lower: bool = True, depth: int | None = None) -> DataFrame:
    """(length, term, total, records) of every n-gram of min_n..max_n words; words of an n-gram are joined by a blank.

    One row of ``texts`` is one record. ``depth`` is how many words the suffixes are sorted by (at least max_n).

    Defined cases: null texts are left out, texts without words have no n-grams, n-grams do not cross records, repeated rows are
    repeated records, an empty table gives no rows.
    """
    lengths = tuple(range(min_n, max_n + 1))
    run = _count(max(depth or max_n, max_n), lengths, pattern, lower)
    counted = spread(texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull())).mapInArrow(run, "length int, term string, total bigint, records bigint")
    return counted.groupBy("length", "term").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def repeated_ngrams(texts: DataFrame, record: str, text: str, min_n: int = 1, start: int = 3, max_n: int | None = None, pattern: str = "[a-z]+", lower: bool = True) -> DataFrame:
    """(length, term, total, records) of every n-gram of at least ``min_n`` words that occurs more than once, up to the longest repeat.

    Suffix arrays count up to ``start`` words. From there on a longer n-gram can only repeat where both n-grams that make it up
    repeat, so each further length looks at the places that are left, and the last length is the longest repeat (or ``max_n``).
    Few places are left in texts that aren't copies of each other; with copies in them there are as many rounds as the longest has words.

    ``record`` identifies a record. Defined cases: as in :func:`ngram_counts`.
    """
    known = texts.where(F.col(text).isNotNull())
    counts = cut(ngram_counts(known, text, start, min(min_n, start), pattern, lower).where("total > 1"))
    body = F.lower(F.col(text)) if lower else F.col(text)
    words = known.select(F.col(record).alias("record"), F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1)).alias("x")).where(F.size("x") >= start)
    grams = words.select("record", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("x") - (start - 1)), lambda i: F.array_join(F.slice("x", i, start), " "))).alias("pos", "term"))
    repeated, n = counts.where(F.col("length") == start), start
    result, live = counts.where(F.col("length") >= min_n), grams
    while max_n is None or n < max_n:
        live = live.join(repeated.select("term"), "term", "left_semi")
        after = Window.partitionBy("record").orderBy("pos")
        follows = live.select("record", "pos", "term", F.lead(F.struct("pos", "term")).over(after).alias("next")).where(F.col("next.pos") == F.col("pos") + 1)
        live = cut(follows.select("record", "pos", F.concat("term", F.lit(" "), F.substring_index("next.term", " ", -1)).alias("term")))
        n += 1
        counted = live.groupBy("term").agg(F.count("*").alias("total"), F.count_distinct("record").alias("records")).where("total > 1")
        repeated = cut(counted.select(F.lit(n).alias("length"), "term", "total", "records"))
        if not repeated.limit(1).count():
            break
        if n >= min_n:
            result = result.unionByName(repeated)
    return result


def _count_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_count` for documents given as lists of terms with their numbers of occurrences, which become runs of one term."""
    held: list[np.ndarray] = []
    sizes: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        w = np.concatenate(held)
        record = np.repeat(np.arange(len(sizes)), sizes)
        order, common = suffix_array(w, record, 1)
        first, occurrences, records = intervals(order, common, record, len(w), 1)
        yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(occurrences), pa.array(records)], names=["w", "total", "records"])

    for batch in batches:
        terms, n = batch.column(0), batch.column(1)
        starts = terms.offsets.to_numpy()
        flat_w, flat_n = terms.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            tokens = np.repeat(flat_w[a:b], flat_n[a:b])
            held.append(tokens)
            sizes.append(len(tokens))
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield from flush()
                held, sizes, size = [], [], 0
    if held:
        yield from flush()


def vector_counts(tf: DataFrame, doc: str = "doc_id", term: str = "w", n: str = "n") -> DataFrame:
    """(w, total, records) of each term of term-frequency vectors in long form, from suffix arrays over the documents.

    A vector has no order: its document is the sequence of its terms, each as often as it occurs, and n-grams are single terms.

    Defined cases: repeated deliveries of (doc, term) count once (the largest n); n that is null
    or not positive is no occurrence; null documents or terms are left out.
    """
    valid = tf.where(F.col(doc).isNotNull() & F.col(term).isNotNull() & (F.col(n) > 0))
    # deliveries of a document meet in its list; the largest n of a term is the last of its entries
    lists = valid.groupBy(F.col(doc).alias("doc")).agg(F.array_sort(F.collect_set(F.struct(F.col(term).cast("bigint").alias("w"), F.col(n).cast("bigint").alias("n")))).alias("t"))
    last = F.filter("t", lambda x, i: F.coalesce(F.get(F.col("t"), i + 1)["w"] != x["w"], F.lit(True)))
    once = lists.select(last.alias("t")).select(F.col("t.w").alias("w"), F.col("t.n").alias("n"))
    counted = once.mapInArrow(_count_vectors, "w bigint, total bigint, records bigint")
    return counted.groupBy("w").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def mark(total, records, n_records, rare_up_to: int = 2, common_share: float = 0.5):
    """``rare``, ``common`` or null as a Column."""
    return F.when(total <= rare_up_to, "rare").when(records > n_records * common_share, "common")
