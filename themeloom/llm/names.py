"""Variant spellings of names typed by people.

Spellings become weighted vectors of character n-grams of the whole name: of the family name, and with less
weight of the given name and its initial, each by frequency and rarity. A sparse similarity join finds
for every spelling its nearest ones above a cosine threshold inside a block of a reliable attribute (here the
place of the affiliation). It is exact: with the n-grams of each vector ordered from rare to common, two vectors above the
threshold share an n-gram among the first few, so only these are joined, and the common n-grams, whose
lists are long, never meet. A check of name parts in SQL takes out pairs whose given names contradict each other;
average-linkage clustering over the remaining cosines groups the spellings.

Short forms of given names that share few letters with the full form are learned from the table itself: pairs of given
names that occur with the same family name at the same place far more often than chance. A list of common ones may be added.

Average linkage merges pairs that are each other's nearest; as it is reducible, all such
pairs can merge in one round and give the same tree as one merge at a time. Each round is
a few aggregations over the remaining links, so no component ends up in one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm import cooccurrence
from themeloom.plans.lineage import cut

#: Words of affiliations that are not the place.
GENERIC = frozenset("the of for and at in de university univ institute institut inst technology tech technical academy acad science sciences sci lab labs laboratory laboratories research center centre department dept school college".split())
#: Words that mark a body instead of a person.
BODY = re.compile(r"\b(?:inst|institute?|institut|stud|studies|university|univ|laborator\w*|labs?|academy|acad|group|cent(?:er|re)|dept|department|consortium|society|council|agency)\b")
PARTICLES = frozenset("van von de del della der den di da dos du la le ten ter zu v d".split())
#: Common English short forms of given names, by full form; a default that callers may replace.
SHORT_FORMS = {
    "abigail": "abby", "abraham": "abe", "albert": "al bert", "alexander": "alex sandy xander", "alexandra": "alex sandra", "alfred": "alf fred", "andrew": "andy drew", "anthony": "tony", "arthur": "art", "barbara": "barb", "benjamin": "ben benny", "bernard": "bernie",
    "catherine": "cathy kate katie", "charles": "charlie chuck", "christine": "chris tina", "christopher": "chris kit", "cynthia": "cindy", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "donald": "don", "dorothy": "dot", "edward": "ed eddie ned ted", "eleanor": "ellie nell",
    "elizabeth": "beth betty eliza liz", "eugene": "gene", "frances": "fran", "francis": "frank", "frederick": "fred", "gabriel": "gabe", "gerald": "gerry jerry", "gregory": "greg", "harold": "hal harry", "henry": "hal hank harry", "isabella": "bella", "jacob": "jake", "james": "jamie jim jimmy", "jeffrey": "jeff",
    "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie", "kenneth": "ken", "lawrence": "larry", "leonard": "len", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mick mickey mike", "nathaniel": "nat nate",
    "nicholas": "nick", "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becca becky", "richard": "dick rich rick", "robert": "bob bobby rob", "ronald": "ron", "samuel": "sam", "stephen": "steve", "steven": "steve",
    "susan": "sue susie", "theodore": "ted theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky", "vincent": "vince", "walter": "walt", "william": "bill billy liam will", "zachary": "zach",
}
#: Least number of places where two given names share a family name, and how much more often than chance, for one to be a form of the other.
LEARN_FROM, LEARN_LIFT = 3, 10.0
#: Share of the family name in a vector's squared length, and of the initial in that of a given name.
FAMILY_SHARE, INITIAL_SHARE = 0.7, 0.5
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'"})

NODE = "block string, family string, wide string, given string, middle string, body boolean"


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def place_of(affiliation: str | None) -> str:
    """The reliable word of an affiliation: what remains without generic words."""
    return " ".join(sorted(w for w in re.findall(r"[^\W\d_]+", fold(affiliation or "")) if w not in GENERIC and len(w) > 1))


def parse_name(name: str | None, place: str) -> tuple[str, str, str, str, bool]:
    """(family, wide family, given, middle, body) of a spelling.

    ``wide`` also holds a word before the family name that may be its first half. Of a body,
    ``family`` has the content words and ``given`` the acronym. Initials are single letters.
    """
    raw = name or ""
    text = fold(raw)
    places = set(place.split())
    words = re.findall(r"[^\W\d_]+", text)
    if BODY.search(text):
        content = [w for w in words if w not in places and w not in ("the", "of", "for", "and")]
        return " ".join(content[1:-1] or content), "", "".join(w[0] for w in content), "", True
    rest = [w for w in re.findall(r"[^\W\d_]+", raw) if fold(w) not in places]
    if len(words) > len(rest) == 1 and len(rest[0]) > 2 and rest[0].isupper():
        return "", "", words[0] if words[0] not in places else words[-1], "", True
    if "," in text:
        last, _, first = text.partition(",")
        family = [w for w in re.findall(r"[^\W\d_]+", last) if w not in PARTICLES or len(last.split()) == 1]
        given = re.findall(r"[^\W\d_]+", first)
        joined = "".join(family)
        return joined, joined, given[0] if given else "", given[1] if len(given) > 1 else "", False
    parts = re.sub(r"[^\w\s.'-]|[\d_]", " ", text).replace(".", ". ").split()
    if not parts:
        return "", "", "", "", False
    first_particle = next((i for i, w in enumerate(parts) if i and (w in PARTICLES and len(w) > 1 or w in ("v.", "d.") and raw.split()[min(i, len(raw.split()) - 1)][:1].islower())), None)
    letters = lambda ws: "".join(c for w in ws for c in w if c.isalpha())
    if first_particle is not None:
        given, family = parts[:first_particle], [w for w in parts[first_particle:] if w.rstrip(".") not in PARTICLES] or parts[-1:]
        wide = family
    else:
        given, family = parts[:-1], parts[-1:]
        wide = parts[-2:] if len(parts) > 2 and len(letters(parts[-2:-1])) > 1 else family
    middle = letters(given[1:2]) if len(given) > 1 else ""
    return letters(family), letters(wide), letters(given[:1]), middle, False


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(1).to_pylist()
        places = [place_of(x) for x in batch.column(2).to_pylist()]
        parsed = [parse_name(n, p) for n, p in zip(names, places)]
        columns = [[p[i] for p in parsed] for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(places, pa.string()), *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.bool_())],
            names=["name_id", "block", "family", "wide", "given", "middle", "body"],
        )


def _grams(word: Column, size: int = 2) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))


def _words_grams(text: Column, size: int = 2) -> Column:
    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: _grams(w, size)))


def ngram_vectors(nodes: DataFrame, key: str, block: str, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(block, key, gram, df, v): unit vectors of the n-grams of several parts of a name.

    ``parts``: by prefix, the array of a part's n-grams and the part's share of the squared length; a part without n-grams
    leaves its share to the others. Within a part n-grams weigh by frequency and rarity. Rarity is damped by a
    root: n-grams that a typing error makes are the rarest of all and would otherwise outweigh those that two spellings share.
    """
    listed = F.flatten(F.array(*[F.transform(grams, lambda g: F.struct(F.lit(p).alias("part"), F.concat(F.lit(p), g).alias("gram"), share.alias("share"))) for p, (grams, share) in parts.items()]))  # noqa: B023
    counts = nodes.select(block, key, F.explode(listed).alias("g")).groupBy(block, key, F.col("g.part").alias("part"), F.col("g.gram").alias("gram")).agg(F.count("*").alias("n"), F.max("g.share").alias("share"))
    counts = cut(counts)
    lists = counts.groupBy("gram").agg(F.count("*").alias("df"))
    total = nodes.count()
    weighted = counts.join(lists, "gram").withColumn("v2", F.col("n") * F.log(1.0 + F.lit(float(total)) / F.col("df")))
    of_part, of_name = Window.partitionBy(block, key, "part"), Window.partitionBy(block, key)
    shared = weighted.withColumn("v2", F.col("v2") / F.sum("v2").over(of_part) * F.col("share"))
    return shared.select(block, key, "gram", "df", F.sqrt(F.col("v2") / F.sum("v2").over(of_name)).alias("v"))


def cosine_join(vectors: DataFrame, key: str, block: str, threshold: float, top: int | None = None, sure: float = 2.0) -> DataFrame:
    """(a, b, cosine) of pairs within a block at or above ``threshold``; a < b.

    Ordered from rare to common, features whose remaining squared weight is below the squared
    threshold cannot alone make a pair, so only the features before them are joined. ``top``: pairs that are
    not among the ``top`` nearest of either side are left out; never those at or above ``sure``.
    """
    rare_first = Window.partitionBy(block, key).orderBy("df", "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prefix = vectors.withColumn("rest", F.sum(F.col("v") * F.col("v")).over(rare_first)).where(F.col("rest") >= threshold * threshold - 1e-9)
    left = prefix.select(block, "gram", F.col(key).alias("a"))
    right = prefix.select(block, "gram", F.col(key).alias("b"))
    candidates = left.join(right, [block, "gram"]).where("a < b").select("a", "b").distinct()
    packed = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("gram", "v"))).alias("m"))
    both = candidates.join(packed.select(F.col(key).alias("a"), F.col("m").alias("ma")), "a").join(packed.select(F.col(key).alias("b"), F.col("m").alias("mb")), "b")
    dot = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.element_at("mb", e["key"]), F.lit(0.0)))
    near = both.select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= threshold)
    if top is None:
        return near
    near = cut(near)
    sides = near.select("a", "b", "cosine", F.explode(F.array("a", "b")).alias("of"))
    ranked = sides.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("cosine"), "a", "b")))
    return ranked.where((F.col("r") <= top) | (F.col("cosine") >= sure)).select("a", "b", "cosine").distinct()


def learned_forms(nodes: DataFrame, least: int = LEARN_FROM, lift: float = LEARN_LIFT) -> DataFrame:
    """(name, form): given names that stand with one family name at one place far more often than by chance, in both directions.

    These are short forms and their full forms: two people of a family rarely have the same two given names elsewhere.
    """
    full = nodes.where(~F.col("body") & (F.length("given") > 1) & (F.length("family") > 3))
    pairs = cooccurrence.pair_lift(full.select(F.struct("block", "family").alias("group"), "given"), "group", "given", min_together=least, min_lift=lift)
    pairs = pairs.select("item_a", "item_b")
    return pairs.select(F.col("item_a").alias("name"), F.col("item_b").alias("form")).unionByName(pairs.select(F.col("item_b").alias("name"), F.col("item_a").alias("form")))


def _edits(a: Column, b: Column) -> Column:
    """Edit distance; two neighbouring letters in the wrong order are one edit."""
    d = F.levenshtein(a, b)
    letters = lambda x: F.array_sort(F.split(x, ""))
    return F.when((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)), 1).otherwise(d)


def _given_edits(a: Column, b: Column, forms_a: Column, forms_b: Column) -> Column:
    """Edits between two given names or their forms; null if they contradict each other."""
    initial = F.exists(forms_a, lambda x: F.exists(forms_b, lambda y: F.substring(x, 1, 1) == F.substring(y, 1, 1)))
    least = F.array_min(F.flatten(F.transform(forms_a, lambda x: F.transform(forms_b, lambda y: _edits(x, y)))))
    shorter = F.least(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == ""), 0)
        .when((F.length(a) == 1) | (F.length(b) == 1), F.when(initial, 0))
        .when(F.arrays_overlap(forms_a, forms_b), 0)
        .when((least == 1) & (shorter > 2), 1)
        .when((least == 2) & (shorter > 4), 2)
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """(a, b, s) of pairs whose names don't contradict each other; s is the cosine, less where only the middle names differ.

    ``pairs`` has a, b, cosine and, for both sides, family, wide, given, middle, body, forms.
    """
    c = F.col
    given = _given_edits(c("given_a"), c("given_b"), c("forms_a"), c("forms_b"))

    def family(x: Column, y: Column) -> Column:
        d, short = _edits(x, y), F.least(F.length(x), F.length(y))
        fits = (x != "") & (y != "") & ((d < 2) | (d == 2) & (short > 5))
        both = d + given
        return F.coalesce(fits & ((both <= 2) | (both == 3) & (short > 8)), F.lit(False))

    same_family = family(c("family_a"), c("family_b"))
    person = same_family | family(c("wide_a"), c("family_b")) | family(c("family_a"), c("wide_b"))
    content = F.when((c("family_a") == "") | (c("family_b") == ""), c("given_a") == c("given_b")).otherwise(F.levenshtein(c("family_a"), c("family_b")) <= 3)
    middle = (c("middle_a") != "") & (c("middle_b") != "") & same_family & (F.substring("middle_a", 1, 1) != F.substring("middle_b", 1, 1))
    fits = F.when(c("body_a") != c("body_b"), False).when(c("body_a"), content).otherwise(person)
    return pairs.where(fits).select("a", "b", F.when(middle, 0.3 * c("cosine")).otherwise(c("cosine")).alias("s"))


def average_linkage(links: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster) for every node of ``links`` (a, b, s) that joins another one; pairs without a link count 0.

    Clusters carry their smallest node. Merging stops when no two clusters have a mean likeness
    of at least ``threshold``. Every round merges all pairs that are each other's nearest; ties go
    to the smaller ids.
    """
    edges = cut(links.where("s > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s")).where("a < b").select("a", "b", "s", F.lit(1).cast("bigint").alias("na"), F.lit(1).cast("bigint").alias("nb")))
    spark = edges.sparkSession
    moves: DataFrame | None = None
    while True:
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        near = edges.withColumn("mean", mean).where(F.col("mean") >= threshold)
        rank = F.struct("mean", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
        best = near.select(F.explode(F.array("a", "b")).alias("c"), rank.alias("rank"), "na", "nb").groupBy("c").agg(F.max(F.struct("rank", "na", "nb")).alias("top"))
        pairs = best.groupBy((-F.col("top.rank.x")).alias("a"), (-F.col("top.rank.y")).alias("b")).agg(F.count("*").alias("n"), F.max(F.col("top.na") + F.col("top.nb")).alias("size"))
        merged = cut(pairs.where("n = 2").select("a", "b", "size"))
        if not merged.take(1):
            break
        # members so far follow their cluster; newly merged ones are added
        step = merged.select(F.col("b").alias("node"), F.col("a").alias("cluster"))
        if moves is not None:
            hop = merged.select(F.col("b").alias("cluster"), F.col("a").alias("to"))
            moved = moves.join(hop, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))
            step = moved.unionByName(step)
        moves = cut(step)
        size_of = merged.select(F.explode(F.array(F.struct(F.col("a").alias("old"), F.col("a").alias("new"), "size"), F.struct(F.col("b").alias("old"), F.col("a").alias("new"), "size"))).alias("m")).select("m.*")
        for side, n in (("a", "na"), ("b", "nb")):
            renamed = size_of.select(F.col("old").alias(side), F.col("new").alias("to"), "size")
            edges = edges.join(renamed, side, "left").withColumns({side: F.coalesce("to", side), n: F.coalesce("size", n)}).drop("to", "size")
        swap = F.col("a") > F.col("b")
        edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        edges = cut(edges.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    if moves is None:
        return spark.createDataFrame([], "node bigint, cluster bigint")
    heads = moves.select(F.col("cluster").alias("node"), "cluster").distinct()
    return moves.unionByName(heads)


def link_names(names: DataFrame, key: str = "name_id", name: str = "name", affiliation: str = "affiliation", cosine: float = 0.45, threshold: float = 0.4, top: int | None = 64, short_forms: dict[str, str] | None = None, learn: bool = True) -> DataFrame:
    """(name_id, entity_id): the entity of every spelling; the entity's id is its smallest name_id.

    Spellings that are equal after folding case and accents, at the same place, are one node. ``cosine``: least cosine of
    the join; ``threshold``: least mean cosine of clusters that merge; ``top``: nearest spellings that the join keeps for each
    (never leaving out one that could reach ``threshold`` on its own side, so only the linkage's weak links; None: all);
    ``short_forms``: short forms by given name (default: ``SHORT_FORMS``); ``learn``: whether to learn more of them from the table.

    Defined cases: null keys are left out; null or empty names, and names without letters, are
    entities of their own; null affiliations share one block; repeated rows count once; other columns are ignored.
    """
    rows = names.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("name_id"), F.col(name).alias("name"), F.col(affiliation).alias("affiliation")).dropDuplicates(["name_id"])
    parsed = cut(rows.mapInArrow(_parse, f"name_id bigint, {NODE}"))
    fields = ["block", "family", "wide", "given", "middle", "body"]
    usable = parsed.where((F.col("family") != "") | (F.col("given") != ""))
    nodes = usable.groupBy(*fields).agg(F.min("name_id").alias("node"))
    members = usable.join(nodes, fields).select("name_id", "node")
    nodes = cut(nodes)
    # forms of a given name: itself, what it may be short for, and learned ones
    listed = [(short, full) for full, shorts in (SHORT_FORMS if short_forms is None else short_forms).items() for short in shorts.split()]
    known = nodes.sparkSession.createDataFrame(listed, "name string, form string")
    if learn:
        known = known.unionByName(learned_forms(nodes))
    forms = known.groupBy(F.col("name").alias("given")).agg(F.collect_set("form").alias("more"))
    nodes = nodes.join(forms, "given", "left").withColumn("forms", F.concat(F.array("given"), F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    nodes = cut(nodes)
    # the word before the family name stays a word of its own
    first_half = F.when(F.col("wide").endswith(F.col("family")), F.expr("substring(wide, 1, length(wide) - length(family))")).otherwise("")
    none = F.array().cast("array<string>")
    person = ~F.col("body") & (F.col("given") != "")
    parts = {
        "f:": (_words_grams(F.concat_ws(" ", "family", first_half)), F.lit(FAMILY_SHARE)),
        "g:": (F.when(person & (F.length("given") > 1), _grams(F.col("given"))).otherwise(none), F.lit((1 - FAMILY_SHARE) * (1 - INITIAL_SHARE))),
        "i:": (F.when(person, F.array_distinct(F.transform("forms", lambda x: F.substring(x, 1, 1)))).otherwise(none), F.when(F.length("given") > 1, (1 - FAMILY_SHARE) * INITIAL_SHARE).otherwise(1 - FAMILY_SHARE)),
        # of bodies: the acronym
        "=": (F.when(F.col("body") & (F.col("given") != ""), F.array("given")).otherwise(none), F.lit(FAMILY_SHARE)),
    }
    vectors = cut(ngram_vectors(nodes, "node", "block", parts))
    near = cosine_join(vectors, "node", "block", cosine, top, threshold)
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(f).alias(f"{f}_{s}") for f in [*fields[1:], "forms"]])
    groups = average_linkage(agreement(near.join(side("a"), "a").join(side("b"), "b")), threshold)
    entity = members.join(groups, members.node == groups.node, "left").select("name_id", F.coalesce("cluster", members.node).alias("entity_id"))
    alone = parsed.where((F.col("family") == "") & (F.col("given") == "")).select("name_id", F.col("name_id").alias("entity_id"))
    return entity.unionByName(alone)


def name_pairs(entities: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b): all pairs of spellings of one entity, name_id_a < name_id_b."""
    a = entities.select("entity_id", F.col("name_id").alias("name_id_a"))
    b = entities.select("entity_id", F.col("name_id").alias("name_id_b"))
    return a.join(b, "entity_id").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
