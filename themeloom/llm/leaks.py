"""Held-out evaluation texts inside a training corpus, found by winnowing.

Texts become words without layout, markup, case, punctuation and letter forms. Every k
words in a row have a hash; in each window of w such hashes the smallest is kept. Corpus and
items keep by the same rule, so every shared span of at least w + k - 1 words shares a
kept hash. The kept hashes of corpus and items are joined; hits are gathered per document and item, and extended
word by word into passages.

The corpus is fingerprinted once, whatever the number of items. The join is left to the optimizer: while the items'
fingerprints are below its size limit for broadcasts no text and no fingerprint of the corpus moves; beyond it fingerprints are
shuffled by hash and adaptive execution splits frequent ones. Only texts with hits are read again for the extension.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.plans.lineage import cut, spread

#: Words in one hash, hashes in one window.
K, WINDOW = 3, 2
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝвкмнтгАВЕКМНОРСТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧøØłŁđĐıßæÆœŒ",
    "aeopcyxijshdqwbkmhtrABEKMHOPCTYXaeiknoptuxABEZHIKMNOPTYXoOlLdDisaAoO",
)
_TAG = re.compile(r"<[^<>]*>")
_SPLIT_WORD = re.compile(r"(?<=[^\W\d_])(?:­|[-‐‑]\s*\n\s*)(?=[^\W\d_])")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text, without markup, case, accents and letter forms."""
    text = _TAG.sub(" ", html.unescape(text))
    text = _HIDDEN.sub("", _SPLIT_WORD.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def winnow(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept: the smallest hash of every window, the rightmost of equal ones."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            grams = (grams * np.uint64(0x9E3779B97F4A7C15) ^ (grams >> np.uint64(29))) + hashes[i : i + n]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
    w = min(window, n)
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)
    at = np.unique(np.arange(n - w + 1) + (w - 1) - np.argmin(windows[:, ::-1], axis=1))
    return at, grams[at]


def _chain(doc: np.ndarray, item: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Longest chain of matching word pairs that rises in both texts: (document, item) positions, their difference within low..high."""
    order = {}
    for j, w in enumerate(item.tolist()):
        order.setdefault(w, []).append(j)
    pairs = [(i, j) for i, w in enumerate(doc.tolist()) for j in reversed(order.get(w, ())) if low <= i - j <= high]
    # longest increasing subsequence in item positions; of one document word only one position can be taken
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        t = bisect_left(tails, j)
        if t:
            back[p] = ends[t - 1]
        tails[t : t + 1], ends[t : t + 1] = [j], [p]
    out, p = [], ends[-1] if ends else -1
    while p >= 0:
        out.append(pairs[p])
        p = back[p]
    return out[::-1]


def _runs(at_doc: list[int], at_item: list[int], reach: int, gap: int) -> list[list[int]]:
    """Hits in document order grouped into passages: each follows the last hit of its passage closely in both texts.

    Open passages are indexed by the item position of their last hit, so that any number of them may be open at once;
    of several that a hit could follow it takes the one with the least change of distance, the latest of equal ones.
    """
    runs: list[list[int]] = []
    open_at: dict[int, list[list[int]]] = {}
    for h, (i, j) in enumerate(zip(at_doc, at_item)):
        best = None
        for p in range(j, j - reach - 4 - 1, -1):
            listed = open_at.get(p)
            if not listed:
                continue
            listed[:] = [g for g in listed if i - at_doc[g[-1]] <= reach]  # what lies too far back never continues
            for g in listed:
                change = abs((i - at_doc[g[-1]]) - (j - p))
                if change <= gap and (best is None or change <= best[0]):
                    best = (change, p, g)
        if best is None:
            run = [h]
            runs.append(run)
        else:
            _, p, run = best
            open_at[p].remove(run)
            run.append(h)
        open_at.setdefault(j, []).append(run)
    return runs


def passages(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, k: int = K, gap: int = 12, least: int = 4) -> list[int]:
    """Item words reproduced in each passage, the largest first.

    Hits closer than ``gap`` words on a similar diagonal form a passage. It is extended by half a
    gap on both sides and aligned; runs of fewer than ``least`` aligned words with little between
    them and the rest are scraps.
    """
    order = np.lexsort((at_item, at_doc))
    at_doc, at_item = at_doc[order], at_item[order]
    found: list[tuple[int, set[int]]] = []
    for g in _runs(at_doc.tolist(), at_item.tolist(), gap + k, gap):
        lo, hi = at_doc[g].min(), at_doc[g].max() + k
        a, b = at_item[g].min(), at_item[g].max() + k
        span = slice(max(0, lo - gap // 2), hi + gap // 2)
        part = slice(max(0, a - gap // 2), b + gap // 2)
        shifts = (at_doc[g] - span.start) - (at_item[g] - part.start)
        aligned = _chain(doc[span], item[part], int(shifts.min()) - gap, int(shifts.max()) + gap)
        # words that match alone, far from any other, are chance
        kept = {j + part.start for n, (i, j) in enumerate(aligned) if any(0 <= m < len(aligned) and m != n and abs(aligned[m][0] - i) <= 3 and abs(aligned[m][1] - j) <= 3 for m in (n - 1, n + 1))}
        if len(kept) >= least:
            found.append((len(kept), kept))
    found.sort(key=lambda x: -x[0])
    sizes, taken = [], set()
    for _, kept in found:
        new = kept - taken
        if new:
            sizes.append(len(new))
            taken |= new
    return sorted(sizes, reverse=True)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, pos) of every kept hash, for (id, text)."""
    for batch in batches:
        kept = [winnow(word_hashes(words_of(t))) for t in batch.column(1).to_pylist()]
        if kept:
            ids = np.repeat(batch.column(0).to_numpy(), [len(at) for at, _ in kept])
            at, hashes = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32))], names=["id", "hash", "pos"])


def _extend(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[tuple, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            last, doc, doc_at, doc_kept = None, *[np.zeros(0, np.uint64)] * 3
            for doc_id, text, item_id, item_text in zip(*[c.to_pylist() for c in batch.columns]):
                if last != (doc_id, text):
                    last, doc = (doc_id, text), word_hashes(words_of(text))
                    doc_at, doc_kept = winnow(doc)
                if (item_id, item_text) not in items:
                    if len(items) > 10_000:  # a cache, not a limit
                        items.clear()
                    words = word_hashes(words_of(item_text))
                    at, kept = winnow(words)
                    order = np.argsort(kept, kind="stable")
                    items[item_id, item_text] = words, at[order], kept[order]
                item, item_at, item_kept = items[item_id, item_text]
                lo, hi = np.searchsorted(item_kept, doc_kept, "left"), np.searchsorted(item_kept, doc_kept, "right")
                n = hi - lo
                rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                sizes = passages(doc, item, np.repeat(doc_at, n), item_at[rows])
                best = sum(sizes[:2])
                if best >= share * len(item):
                    out.append((doc_id, item_id, best / len(item), len(sizes[:2])))
            columns = [list(c) for c in zip(*out)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["doc_id", "item_id", "share", "passages"])

    return run


def fingerprints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, hash, pos): the winnowed hashes of every text."""
    narrow = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return spread(narrow).mapInArrow(_fingerprint, "id bigint, hash bigint, pos int")


def find_leaks(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.4, min_hits: int = 3, stock_items: int | None = None) -> DataFrame:
    """(doc_id, item_id, share, passages) of documents that reproduce at least ``share`` of an item's words in one or two passages.

    ``min_hits``: places in an item at which a document must share a kept hash before passages are aligned; 1 is the exact mode, which follows
    every shared span of K + WINDOW - 1 words. A document that reproduces two fifths of 40 words with every sixth of them changed has four or more; on the
    0.1 tables every found pair has at least twelve and the exact mode finds the same pairs. ``stock_items``: hashes that more items hold are stock wording and no hits (the words still count in
    passages that other hits find); by default none is. Ids are expected to be unique; of a repeated id each text counts.

    Defined cases: null texts and ids, and items of fewer than k words, give no rows; repeated
    rows give repeated results that are then made distinct; empty tables give no rows; other columns are ignored.
    """
    docs = corpus.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    wanted = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    of_items = cut(fingerprints(wanted, "item_id", "item_text").select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("item_pos")))
    if stock_items is not None:
        stock = of_items.groupBy("hash").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") > stock_items)
        of_items = of_items.join(stock, "hash", "left_anti")
    hits = fingerprints(docs, "doc_id", "text").join(of_items, "hash")
    # places in an item: bounded by its length
    pairs = hits.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.size(F.collect_set("item_pos")).alias("places"))
    pairs = cut(pairs.where(F.col("places") >= min_hits).select("doc_id", "item_id"))
    found = docs.join(pairs, "doc_id").join(wanted, "item_id").select("doc_id", "text", "item_id", "item_text")
    found = found.repartition("doc_id", "item_id")  # only texts with hits move; they are few and need most of the work
    return found.mapInArrow(_extend(share), "doc_id bigint, item_id bigint, share double, passages int").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max_by("passages", "share").alias("passages"))
