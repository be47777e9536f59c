import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import cooccurrence, leaks, mixing, names, subjects, terms, truncation

# ---- names


def linked(spark, rows):
    df = spark.createDataFrame([(i, n, a, 1, "clash") for i, (n, a) in enumerate(rows)], "name_id bigint, name string, affiliation string, rec_id bigint, block string")
    return {r["name_id"]: r["entity_id"] for r in names.link_names(df).collect()}


def test_names(spark):
    uni, labs = "University of Rome", "Milan Labs"
    rows = [
        ("Deborah Figemond", uni), ("Figemond, Debbie", "Rome Univ."), ("D. Figemond", uni), ("deborah FIGEMOND", uni), ("Deborah Figemnod", uni), ("Walter Figemond", uni), ("Deborah Figemond", labs),
        ("Rome Institute for Mixed Chain Studies", uni), ("IMCS Rome", uni), ("Institute for Mixed Chian Studies, Rome", uni), (None, uni), ("", None), ("...", uni), ("Irena de la Lakesk-Fideell", uni), ("de la Lakesk Fideell, I.", uni), ("Deborah Figemond", uni),
    ]
    got = linked(spark, rows)
    assert len(got) == len(rows)
    assert {got[i] for i in (0, 1, 2, 3, 4, 15)} == {0}
    assert got[5] == 5 and got[6] == 6 and {got[7], got[8], got[9]} == {7} and got[13] == got[14] == 13
    assert [got[i] for i in (10, 11, 12)] == [10, 11, 12]


def test_no_names(spark):
    assert linked(spark, []) == {}


def test_cosine_join_is_exact(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(6)) for _ in range(60)]
    nodes = spark.createDataFrame([(i, "b", w) for i, w in enumerate(words)], "node bigint, block string, text string")
    vectors = names.ngram_vectors(nodes, "node", "block", {"f:": (names._words_grams(F.col("text")), F.lit(1.0))})
    table = defaultdict(dict)
    for r in vectors.collect():
        table[r["node"]][r["gram"]] = r["v"]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if sum(v * table[b].get(g, 0) for g, v in table[a].items()) >= 0.4}
    assert {(r["a"], r["b"]) for r in names.cosine_join(vectors, "node", "block", 0.4).collect()} == want
    cosine = {(r["a"], r["b"]): r["cosine"] for r in names.cosine_join(vectors, "node", "block", 0.4).collect()}
    nearest = set()
    for i in range(60):
        nearest |= set(sorted((p for p in cosine if i in p), key=lambda p: (-cosine[p], p))[:2])
    got = {(r["a"], r["b"]) for r in names.cosine_join(vectors, "node", "block", 0.4, 2, 0.8).collect()}
    assert got == nearest | {p for p, c in cosine.items() if c >= 0.8}


def test_short_forms_are_learned(spark):
    rng = random.Random(16)
    forms = {"wolfgang": "poldi", "aurelio": "tuccio", "brigid": "delia", "ludmila": "mika", "evander": "zan", "hortense": "tessie"}
    others = "oscar yvonne ramon ingeborg kiran noriko boris chandra emeka farid gudrun hiroshi jana lukas mehmet olga priya quentin rosa sven tamar ulrike viktor xenia".split()
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows, who = [], {}
    for person in range(400):
        family = "".join(rng.choices(syllables, k=4)) + "mond"
        given = rng.choice([*forms, *others])
        typo = family[:2] + family[3] + family[2] + family[4:]
        for spelled in {f"{given.title()} {family.title()}", f"{family.title()}, {given[0].upper()}.", f"{given.title()} {typo.title()}", f"{forms.get(given, given).title()} {family.title()}"}:
            who[len(rows)] = person
            rows.append((spelled, f"University of Place{'abcdefghij'[person % 10] * 3}"))
    want = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if who[a] == who[b]}
    df = spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(rows)], "name_id bigint, name string, affiliation string")
    got = {tuple(r) for r in names.name_pairs(names.link_names(df, short_forms={})).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


def slow_linkage(n, sims, threshold):
    groups = [{i} for i in range(n)]
    while True:
        best = max(((sum(sims.get((min(x, y), max(x, y)), 0) for x in a for y in b) / (len(a) * len(b)), -min(min(a), min(b)), -max(min(a), min(b)), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)), default=None)
        if best is None or best[0] < threshold:
            return {frozenset(g) for g in groups if len(g) > 1}
        i, j = best[3], best[4]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] | groups[j]]


def test_average_linkage_against_serial(spark):
    rng = random.Random(7)
    sims = {(a, b): round(rng.random(), 6) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.5}
    links = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a bigint, b bigint, s double")
    got = defaultdict(set)
    for r in names.average_linkage(links, 0.4).collect():
        got[r["cluster"]].add(r["node"])
    assert {frozenset(g) for g in got.values()} == slow_linkage(14, sims, 0.4)
    assert all(min(g) == c for c, g in got.items())


# ---- co-occurrence


@pytest.mark.parametrize("heavy", [1, 6, 512])
def test_pairs(spark, heavy):
    rng = random.Random(5)
    rows = [(b, f"i{int(rng.paretovariate(0.7)) % 30}") for b in range(150) for _ in range(rng.randrange(6))]
    baskets = defaultdict(set)
    for b, i in rows:
        baskets[b].add(i)
    n, ab = Counter(i for s in baskets.values() for i in s), Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    total = len(baskets)
    want = {(a, b, n[a], n[b], c) for (a, b), c in ab.items() if c >= 2 and c * total / (n[a] * n[b]) >= 1.1}
    df = spark.createDataFrame([*rows, *rows[:20], (None, "i1"), (3, None)], "rec_id bigint, kw string").withColumn("item", F.lit("clash"))
    got = cooccurrence.pair_lift(df, "rec_id", "kw", 2, 1.1, heavy)
    assert {tuple(r)[:5] for r in got.collect()} == want
    assert cooccurrence.pair_lift(df.limit(0), "rec_id", "kw").count() == 0


@pytest.mark.parametrize("heavy", [2, 8])
def test_pairs_of_large_baskets(spark, heavy, monkeypatch):
    monkeypatch.setattr(cooccurrence, "SEGMENT", 5)
    rng = random.Random(15)
    baskets = {b: {f"i{int(rng.paretovariate(0.5)) % 90}" for _ in range(rng.choice((3, 60)))} for b in range(25)}
    ab = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "rec_id bigint, kw string")
    got = {tuple(r)[:2]: r["n_ab"] for r in cooccurrence.pair_lift(df, "rec_id", "kw", heavy_items=heavy).collect()}
    assert got == dict(ab)


# ---- terms


def test_ngrams(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(40)] + ["", None, "a a a a", "a a a a", "x" * 50_000]
    total, records = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        total.update(grams), records.update(set(grams))
    df = spark.createDataFrame([(t, 1) for t in texts], "abstract string, total int")
    for depth in (3, 7):
        got = terms.ngram_counts(df, "abstract", 3, depth=depth).collect()
        assert {r["term"]: (r["total"], r["records"]) for r in got} == {g: (total[g], records[g]) for g in total}
    assert terms.ngram_counts(df.limit(0), "abstract").count() == 0


def test_repeated_ngrams(spark):
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(25))) for _ in range(60)]
    texts += [texts[3] + " " + texts[3], "z " * 12, "", None]
    total, records = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        grams = [" ".join(w[i : i + n]) for n in range(1, len(w) + 1) for i in range(len(w) - n + 1)]
        total.update(grams), records.update(set(grams))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "rec_id bigint, abstract string, term string")
    want = {g: (len(g.split()), c, records[g]) for g, c in total.items() if c > 1 and len(g.split()) >= 2}
    assert {r["term"]: (r["length"], r["total"], r["records"]) for r in terms.repeated_ngrams(df, "rec_id", "abstract", 2).collect()} == want
    few = {r["term"] for r in terms.repeated_ngrams(df, "rec_id", "abstract", 5, max_n=6).collect()}
    assert few == {g for g, w in want.items() if 5 <= w[0] <= 6}
    assert terms.repeated_ngrams(df.limit(0), "rec_id", "abstract").count() == 0


def test_suffix_array_prefixes():
    tokens, record = np.array([1, 2, 1, 2, 1, 2, 3]), np.array([0, 0, 0, 0, 1, 1, 1])
    order, common = terms.suffix_array(tokens, record, 4)
    ends = [4, 4, 4, 4, 7, 7, 7]
    suffix = [tuple(tokens[i : ends[i]][:4].tolist()) for i in order]
    assert suffix == sorted(suffix)
    for i in range(1, len(order)):
        want = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(suffix[i - 1], suffix[i])))
        assert common[i] == want


def test_vector_counts(spark):
    rows = [(1, 5, 2), (1, 5, 2), (2, 5, 1), (2, 6, 0), (3, 7, 4), (None, 5, 1), (3, None, 1), (4, 7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, w int, n bigint")
    assert {tuple(r) for r in terms.vector_counts(df).collect()} == {(5, 3, 2), (7, 4, 1)}
    assert terms.vector_counts(df.limit(0)).count() == 0


# ---- subjects


def test_planted_subjects(spark):
    rng, rows = random.Random(8), []
    for d in range(90):
        g = d % 3
        for w, n in Counter([g * 12 + int(rng.triangular(0, 12, 0)) for _ in range(30)] + [100 + rng.randrange(200) for _ in range(6)]).items():
            rows.append((d, w, n, "c", 1))
    rows += [(900 + i, 400 + 7 * i + j, 1, "c", 1) for i in range(3) for j in range(7)]
    df = spark.createDataFrame([*rows, *rows[:50], (1, None, 1, "c", 1), (5, 3, 0, "c", 2)], "doc_id bigint, w int, n bigint, corpus string, cell int")
    got = {r["doc_id"]: r["rep_id"] for r in subjects.cluster_documents(df).collect()}
    assert got == {d: d % 3 for d in range(90)}
    report = {r["rep_id"]: r for r in subjects.describe_clusters(df).collect()}
    assert report[0]["size"] == 30 and len(report[0]["typical_docs"]) == 5 and all(x % 3 == 0 for x in report[0]["typical_docs"])
    assert all(w < 12 for w in report[0]["top_terms"])
    assert subjects.cluster_documents(df.limit(0)).count() == 0


def test_subjects_that_share_their_pairs_of_terms(spark):
    draw, rows = random.Random(5), []
    subjects_of = [draw.sample(range(100), 10) for _ in range(60)]  # about 2 700 pairs of terms out of 4 950
    for d in range(720):
        rows += [(d, w, 2) for w in subjects_of[d % 60]]
        rows += [(d, w, 1) for w in draw.sample(range(100, 160), 4)]
    df = spark.createDataFrame(rows, "doc_id long, w int, n long")
    assert {tuple(r) for r in subjects.cluster_documents(df).select("doc_id", "rep_id").collect()} == {(d, d % 60) for d in range(720)}
    report = {r["rep_id"]: r for r in subjects.describe_clusters(df).collect()}
    assert all(report[k]["size"] == 12 and set(report[k]["top_terms"]) <= set(subjects_of[k]) for k in range(60))


def test_small_subject_among_large_ones(spark):
    rng, rows = random.Random(9), []
    for d in range(240):  # large subjects with twelve terms each
        g = d % 4
        rows += [(d, g * 12 + w, n) for w, n in Counter(int(rng.triangular(0, 12, 0)) for _ in range(30)).items()]
    for i in range(4):  # each small document also has the two heaviest terms of another large subject
        rows += [(1000 + i, 500 + w, 4) for w in range(6)] + [(1000 + i, i * 12, 5), (1000 + i, i * 12 + 1, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, w int, n bigint")
    got = {r["doc_id"]: r["rep_id"] for r in subjects.cluster_documents(df).collect()}
    assert got == {d: d % 4 for d in range(240)} | dict.fromkeys(range(1000, 1004), 1000)


def test_spread_smallest(spark):
    nodes = spark.range(12).select("id")
    links = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(9, 11)], "a bigint, b bigint")
    assert {r["id"]: r["label"] for r in subjects.spread_smallest(nodes, links).collect()} == {**dict.fromkeys(range(9), 0), 9: 9, 10: 10, 11: 9}


# ---- leaks


def test_winnowing_guarantee():
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 1 << 40, 20).astype(np.uint64)
    for length in range(leaks.K + leaks.WINDOW - 1, 12):
        a = np.concatenate([rng.integers(0, 1 << 40, 9).astype(np.uint64), shared[:length], rng.integers(0, 1 << 40, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 1 << 40, 4).astype(np.uint64), shared[:length]])
        assert set(leaks.winnow(a)[1]) & set(leaks.winnow(b)[1])


def test_many_open_passages():
    # forty repetitions of one phrase before the passage: every diagonal stays open
    item = np.arange(100, 160, dtype=np.uint64)
    doc = np.concatenate([np.concatenate([item[a : a + 5] for a in range(0, 40, 5)] * 5), np.array([7] * 30, np.uint64), item])
    hits = [(int(i), int(j)) for i in range(len(doc) - 2) for j in range(58) if (doc[i : i + 3] == item[j : j + 3]).all()]
    sizes = leaks.passages(doc, item, np.array([h[0] for h in hits]), np.array([h[1] for h in hits]))
    assert sizes[0] == 60


def test_leaks(spark):
    vocabulary = [f"word{i}" for i in range(500)]
    rng = random.Random(10)
    item = rng.choices(vocabulary, k=60)
    other = lambda n: " ".join(rng.choices(vocabulary, k=n))
    changed = [w if i % 6 else "changed" for i, w in enumerate(item)]
    docs = {
        1: other(40) + " " + " ".join(item) + " " + other(40), 2: " ".join(item[:12]), 3: " ".join(item[:15]) + " " + other(60) + " " + " ".join(item[40:56]), 4: other(90), 5: "<b>" + "</b> <i>".join(w.upper() + ";" for w in item) + "</i>",
        6: other(30) + " " + " ".join(changed), 7: "".join(f"{w} {other(9)} " for w in item), 8: " ".join(x for k in range(0, 60, 5) for x in item[55 - k : 60 - k]), 9: "", 10: None, 11: "Ｗ" + "".join(" ".join(item))[1:].replace("w", "ｗ"), 12: other(20_000) + " ".join(item[5:50]),
    }
    corpus = spark.createDataFrame([(k, v, "s", 1) for k, v in docs.items()], "doc_id bigint, text string, source string, item_id int")
    items = spark.createDataFrame([(77, " ".join(item)), (78, other(50)), (79, "a b"), (80, None)], "item_id bigint, text string")
    for hits, stock in ((1, 64), (1, None), (2, 64)):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(corpus, items, min_hits=hits, stock_items=stock).collect()}
        assert got == {(d, 77) for d in (1, 3, 5, 6, 11, 12)}
    # stock wording alone is no leak, but counts in a leak that other words show
    many = spark.createDataFrame([(100 + i, " ".join(item[:20]) + " " + other(20)) for i in range(6)], "item_id bigint, text string").union(items)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(corpus, many, stock_items=4).collect()}
    assert got == {(d, 77) for d in (1, 3, 5, 6, 11, 12)}
    assert leaks.find_leaks(corpus, items.limit(0)).count() == 0 and leaks.find_leaks(corpus.limit(0), items).count() == 0


def test_wording_of_many_items_is_found(spark):
    words = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(i, f"{words} item{i}") for i in range(70)], "item_id bigint, text string")
    assert leaks.find_leaks(spark.createDataFrame([(1, words)], "doc_id bigint, text string"), items).count() == 70


# ---- mixing


def test_fit_is_best():
    rng = random.Random(11)
    for _ in range(3000):
        lengths = sorted(rng.sample(range(1, 45), rng.randrange(1, 6)))
        counts = [rng.randrange(1, 12) for _ in lengths]
        budget = rng.randrange(0, 300)
        take, best = mixing.fit(lengths, counts, budget)
        assert best
        total = sum(n * k for n, k in zip(lengths, take))
        assert all(0 <= k <= c for k, c in zip(take, counts)) and total <= budget
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
        assert total == max(sums)
    assert mixing.fit([2, 34], [13, 22], 590)[1] and sum(n * k for n, k in zip([2, 34], mixing.fit([2, 34], [13, 22], 590)[0])) == 590
    assert mixing.fit([0, 7], [3, 2], 10) == ([0, 1], True) and mixing.fit([], [], 5) == ([], True)
    big, best = mixing.fit(list(range(50, 900)), [10_000] * 850, 1_234_567_891)
    assert best
    assert sum(n * k for n, k in zip(range(50, 900), big)) == 1_234_567_891


def test_mix(spark):
    rng = random.Random(12)
    rows = [(i, "abc"[i % 3] if i % 9 else "a", rng.randrange(5, 60), 0) for i in range(3000)] + [(9000, None, 50, 0), (9001, "z", 40, 0), (9002, "b", 0, 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, bucket int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 2), ("c", 0.1, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(sized, targets, 3)
    again = mixing.mix(sized.repartition(7), targets, 3)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    report = {r["source"]: r for r in mixing.mix_report(chosen, mixing.source_budgets(mixing.length_counts(sized), targets)).collect()}
    for s in "abc":
        assert report[s]["taken"] == min(report[s]["budget"], report[s]["max_repeats"] * report[s]["size"])
    assert not report["none"]["reachable"] and report["none"]["taken"] == 0 and chosen.where("repeats > 2 or source = 'z'").count() == 0
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["Hello there", "", None, "<|endoftext|> x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["size"] for r in mixing.token_counts(df, "text", path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# ---- truncation

WHOLE = [
    "All is well. It ends here.", "Is it so? It is!", 'He put it, "Done!"', "It ended. (All was well.)", "Text.\nKeywords: a b, c", "Text.\nSee also http://x.example/a/1", "Text.\n-- the editors", "Text.\nTable 3: 7 topics, 4 documents", "Text.\n[4] X Group, A title, 2007",
    "Damaged (about 0.7. With more, it goes on. And on. Then it ends.", "", None, "A <b>bold</b> line <br> ends.", "“As “ he (put) it. <p>So.", "Text.\nTopics: one, two", "More text.\nTopics: two", "Again.\nTopics : four five", "Use Lida-2.", "Text.  \n", "Fin ?", "Ende. „Gut.“", "a" * 100_000 + ".",
]
CUT = [
    "All is well. It en", "All is well. It ends,", "All is well. It ends [more]", "All is wel...", "All is well…", "Text. Some (continued", "Text. With our &am", "Text. We isolate <b", "Text. Flat r�", 'Well. As put, "Which canvases combine!', "Well. (about 0.", "Well. [...]", "Well. The \\u00",
    "a b " * 30_000, "See (this. The rest is fine.", "He wrote “no end. And then more.", "A <b>bold line. It ends.", "Well. So <a href='" + "x" * 500,
]


def test_truncation(spark):
    rows = [(i, t, "s", "x") for i, t in enumerate(WHOLE * 3)] + [(1000 + i, t, "s", "x") for i, t in enumerate(CUT)] + [(2000 + i, "a headline without end", None, "x") for i in range(9)] + [(2100, "a headline [more]", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, evidence string")
    judged = {r["doc_id"]: r for r in truncation.judge(df).collect()}
    for i, t, _, _ in rows:
        assert judged[i]["truncated"] == (1000 <= i < 2000 or i == 2100), (t or "")[:80]
    rates = {r["source"]: r["truncated_docs"] for r in truncation.truncation_by_source(truncation.judge(df)).collect()}
    assert rates == {"s": len(CUT), None: 1}
    assert truncation.judge(df.limit(0)).count() == 0


def test_truncation_in_sources_that_cut(spark):
    words = "early results frame the rest each year and shorten unlabelled comparisons while wider snippets meet newspapers with care".split()
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choices(words, k=9)).capitalize() + "."
    rows = [(i, " ".join(prose() for _ in range(20))[:1000].rstrip(" ."), "limited") for i in range(4)]  # most of the source is cut
    rows += [(10, prose() + " It frames the rest ea", "single")]
    rows += [(20 + i, " ".join(rng.sample(words, 4 + i % 7)), "headlines") for i in range(40)]
    # a headline source cuts too: after a sentence, inside a word, inside a list
    cut = [(100, "Newspapers meet with care. They frame the", "headlines"), (101, "Wider newspapers frame compari", "headlines"), (102, "Results, newspapers,", "headlines"), (103, prose()[:-1] * 4, "headlines")]
    # and short texts cut at one length
    rows += [(200 + i, (" ".join(rng.choices(words, k=12)))[:40].rstrip(), "short") for i in range(30)]
    judged = {r["doc_id"]: r["truncated"] for r in truncation.judge(spark.createDataFrame(rows + cut, "doc_id bigint, text string, source string")).collect()}
    assert [i for i in (*range(4), 10, *range(100, 104), *range(200, 230)) if not judged[i]] == []
    assert [i for i in range(20, 60) if judged[i]] == []
