"""Text cut off by field limits or broken transfers.

A pushdown automaton reads the whole text: quotes, brackets and elements of markup go on a
stack and must come off it again; its end state also says whether the text ends after a terminator, inside
a tag, escape or character, or in the middle of a sentence. A text is accepted if the stack is empty and
it ends after a terminator or in a finished closing line. What counts as a closing line is partly learned:
labels that recur at the start of last lines. What counts as a missing terminator depends on the
source: in a source of headlines, short texts without a finished sentence, whose last word is whole and whose
lengths don't pile up at a limit, need none. All of it is SQL; texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.plans.lineage import cut

#: Characters that may end a sentence, and those that may follow them.
TERMINATORS = ".!?。！？؟।"
CLOSERS = "\"'”’»«“)\\]}›"
#: Forms of closing lines that need no terminator: an address, a signature after a dash, a numbered reference with its year.
CLOSING_FORMS = (
    r"(?:.*\s)?<?[a-z][a-z0-9+.-]*://[^\s/]+\.\w+(?:/\S*)?[\w/]>?",
    r"(?:--|—|–)\s*\S.*\w",
    r"\[\d+\]\s*\S.*,\s*(?:1[5-9]|20)\d\d[a-z]?",
)
#: A last line ``label: value``; numbers in labels are all alike. The label closes a text if it recurs (``LABEL_DOCS``) or is common usage.
LABEL = r"^([\p{L}][^:.!?\n]{0,38}?)\s?:\s*\S(?:.*[^\s,;:(\[\-])?\z"
USUAL_LABELS = ("keywords", "key words", "tags", "source", "see also", "figure 0", "table 0")
LABEL_DOCS = 3
#: Marks that a cut leaves behind.
CUT_MARKS = r"(?i)(?:\[\s*(?:more|\.\.\.|…|mehr|más|suite|truncated|cut)\s*\]|\(\s*(?:continued|cont\.?|more|fortsetzung|suite|continúa)\s*\)?|\b(?:read more|continue reading)|\.\.\.|…|\x{FFFD}+)\s*\z"
#: What a broken transfer leaves at the end: half an escape, half a character.
BROKEN_END = r"(?:&#?[A-Za-z0-9]{0,8}|\\\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?|[\x{D800}-\x{DFFF}\x{FFFD}])\z"
#: Longest headline, and least number of texts from which a source's habit is known.
HEADLINE, SAMPLE = 200, 5
#: Lengths at a source's longest one (a blank at the cut is trimmed), lengths below that they are compared with, and how much denser they must be.
AT_LIMIT, BELOW, PILE = 2, 10, 3
#: A sentence that ends inside a text; short capitalised words before a full stop are abbreviations. Only fixed lengths before the stop, so long words cost no more.
SENTENCE_INSIDE = rf"(?:(?<![\p{{L}}\p{{N}}])\p{{Ll}}\p{{L}}{{2,3}}|\p{{L}}{{5}}|[{CLOSERS}])\.[{CLOSERS}]*\s+[^\s\p{{Ll}}]|[。।]\s*\S"
_WORD = r"[\p{L}\p{M}\p{N}]"
#: Elements that have no end tag, or may go without.
VOID = ("area", "base", "br", "col", "dd", "dt", "embed", "hr", "img", "input", "li", "link", "meta", "option", "p", "param", "source", "td", "th", "tr", "track", "wbr")
#: Finished sentences after which what is still open was left open by damage and not by a cut.
SENTENCES = 2
#: What the automaton reads: tags (also one that never ends), quotes and brackets, ends of sentences inside the text.
_TOKEN = r"</?[A-Za-z][^<>]*(?:>|\z)|<\z|[\"“”„«»()\[\]{}]|[.!?。！？؟।](?=\s+\S)"
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“"}
#: Marks that close one of these if it is open, the first one first, and open otherwise.
_EITHER = {"“": "„“", "«": "»", "»": "«", '"': '"'}


def open_structure(text: Column) -> Column:
    """Stack of the tags, quotes and brackets still open at the end of a text, as an array; a tag cut in two is ``<``.

    Ends of sentences lie on the stack as ``.`` above what is open, at most one more than ``SENTENCES`` in a row.
    A closing mark takes everything off the stack down to its opening mark; one without an opening mark is
    left alone, as damage before the end is no cut.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))

    def taken_off(stack: Column, opener: Column, otherwise: Column) -> Column:
        # how far from the top of the stack the opening mark is; 0 if it is not there
        depth = F.coalesce(F.array_position(F.reverse(stack), opener), F.lit(0))
        return F.when(depth > 0, F.slice(stack, F.lit(1), F.size(stack) - depth.cast("int"))).otherwise(otherwise)

    def of_tag(stack: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
        pushed = F.when(token.endswith("/>") | name.isin(*VOID), stack).otherwise(F.concat(stack, F.array(name)))
        return F.when(~token.endswith(">"), F.concat(stack, F.array(F.lit("<")))).when(token.startswith("</"), taken_off(stack, name, stack)).otherwise(pushed)

    def of_mark(stack: Column, token: Column) -> Column:
        branch = None
        for close, begin in _CLOSES.items():
            off = taken_off(stack, F.lit(begin), stack)
            branch = F.when(token == close, off) if branch is None else branch.when(token == close, off)
        pushed = F.concat(stack, F.array(token))
        for close, begin in _EITHER.items():
            off = pushed
            for one in reversed(begin):
                off = taken_off(stack, F.lit(one), off)
            branch = branch.when(token == close, off)
        return branch.otherwise(pushed)

    def of_end(stack: Column, token: Column) -> Column:
        top = F.slice(stack, -F.least(F.size(stack), F.lit(SENTENCES + 1)), F.lit(SENTENCES + 1))
        return F.when((F.size(stack) > SENTENCES) & F.forall(top, lambda x: x == "."), stack).otherwise(F.concat(stack, F.array(F.lit("."))))

    def step(stack: Column, token: Column) -> Column:
        ends = token.isin(*TERMINATORS)
        return F.when(ends & (F.size(stack) == 0), stack).when(ends, of_end(stack, token)).when(token.startswith("<"), of_tag(stack, token)).otherwise(of_mark(stack, token))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def _label(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(line, LABEL, 1), r"\d+", "0"))


def end_features(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """doc_id, source and the automaton's end state for each text, with the label of its last line."""
    body = F.rtrim(F.col(text), F.lit(" \t\r\n\f\u000b "))
    ends = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), body.alias("body"))
    line = F.trim(F.substring_index("body", "\n", -1))
    form = F.lit(False)
    for pattern in CLOSING_FORMS:
        form = form | line.rlike(rf"^(?:{pattern})\z")
    terminated = F.col("body").rlike(rf"[{TERMINATORS}][{CLOSERS}]*\z") & ~F.col("body").rlike(r"(?:\s|\()\d+\.\z")
    stack = open_structure(F.col("body"))
    return ends.select("doc_id", "source", "body", line.alias("line"), form.alias("form"), terminated.alias("terminated"), stack.alias("stack")).select(
        "doc_id",
        "source",
        F.col("body").rlike(CUT_MARKS).alias("marked"),
        (F.col("body").rlike(BROKEN_END) | F.array_contains("stack", "<")).alias("broken"),
        "terminated",
        "form",
        F.when(~F.col("form") & ~F.col("line").rlike(SENTENCE_INSIDE), F.nullif(_label(F.col("line")), F.lit(""))).alias("label"),
        F.exists(F.slice("stack", -F.greatest(F.least(F.size("stack"), F.lit(SENTENCES + 1)), F.lit(1)), F.lit(SENTENCES + 1)), lambda x: x != ".").alias("opened"),
        (F.col("body") == "").alias("empty"),
        F.length("body").alias("chars"),
        F.xxhash64("body").alias("same"),
        # short, and ends neither inside a list nor after a sentence
        F.when(F.length("body") <= HEADLINE, ~F.col("body").rlike(SENTENCE_INSIDE) & F.col("body").rlike(rf"(?:{_WORD}|[{CLOSERS}%])\z")).otherwise(False).alias("headline"),
        F.when(F.length("body") <= HEADLINE, F.lower(F.regexp_extract("body", rf"({_WORD}+)\z", 1))).otherwise("").alias("last"),
    )


def closing_labels(features: DataFrame) -> DataFrame:
    """(label): labels of last lines that stand in at least ``LABEL_DOCS`` different texts, mostly without a terminator, or are common usage."""
    learned = features.where(F.col("label").isNotNull()).groupBy("label").agg(F.count_distinct("same").alias("n"), F.count_distinct(F.when(~F.col("terminated"), F.col("same"))).alias("bare"))
    return learned.where(((F.col("bare") >= LABEL_DOCS) & (2 * F.col("bare") > F.col("n"))) | F.col("label").isin(*USUAL_LABELS)).select("label", F.lit(True).alias("known"))


def _with_closing(features: DataFrame) -> DataFrame:
    """``features`` with closing_line; only rows with a label are joined, so those without are no hot key."""
    labelled = features.where(F.col("label").isNotNull()).join(closing_labels(features), "label", "left")
    rest = features.where(F.col("label").isNull()).withColumn("known", F.lit(None).cast("boolean"))
    return labelled.unionByName(rest).withColumn("closing_line", F.coalesce("form", F.lit(False)) | F.coalesce("known", F.lit(False))).drop("known", "form", "label")


def _unended() -> Column:
    """Headline-like texts without terminator, closing line or trace."""
    return F.col("headline") & ~(F.col("terminated") | F.col("closing_line") | F.col("marked") | F.col("broken"))


def _usual(n: Column) -> Column:
    """Whether ``n`` of a source's texts are enough for a habit."""
    return (F.count_if(~F.col("empty")) >= SAMPLE) & (2 * n > F.count_if(~F.col("empty")))


def half_words(docs: DataFrame, text: str, features: DataFrame) -> DataFrame:
    """(last, half): last words of headlines that never stand inside a text while longer words that begin like them are at least twice as frequent."""
    lasts = features.where(_unended() & (F.col("last") != "")).groupBy("last").agg(F.count("*").alias("ends"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"({_WORD}++)(?!\z)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # no headline's last word is longer than a headline
    begun = words.select(F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(HEADLINE)))).alias("l"), "word", "n")
    begun = begun.groupBy(F.expr("substring(word, 1, l)").alias("last")).agg(F.max(F.col("l") == F.length("word")).alias("whole"), F.sum("n").alias("n"))
    return lasts.join(begun, "last").where(~F.col("whole") & (F.col("n") >= 2 * F.col("ends"))).select("last", F.lit(True).alias("half"))


def length_limits(features: DataFrame) -> DataFrame:
    """(source, limit): the least length at which a source's different headlines pile up below their longest one; null if they don't."""
    lengths = features.where(_unended()).groupBy("source", "chars").agg(F.count_distinct("same").alias("n"))
    longest = lengths.groupBy("source").agg(F.max("chars").alias("longest")).withColumnRenamed("source", "of")
    joined = lengths.join(longest, F.col("source").eqNullSafe(F.col("of")))
    below = F.col("longest") - F.col("chars")
    counts = joined.groupBy("source", "longest").agg(F.sum(F.when(below < AT_LIMIT, F.col("n")).otherwise(0)).alias("at"), F.sum(F.when((below >= AT_LIMIT) & (below < AT_LIMIT + BELOW), F.col("n")).otherwise(0)).alias("before"))
    piled = (F.col("at") >= 3) & (F.col("at") * BELOW >= PILE * AT_LIMIT * F.col("before"))
    return counts.select("source", F.when(piled, F.col("longest") - AT_LIMIT + 1).alias("limit"))


def source_habits(features: DataFrame) -> DataFrame:
    """(source, loose, untidy): whether most of a source's texts are headlines that show no sign of a cut (``plain``), and
    whether so many of its texts that end after a terminator leave structure open that this tells nothing."""
    ended = F.col("terminated") & ~F.col("marked") & ~F.col("broken")
    untidy = (F.count_if(ended) >= SAMPLE) & (4 * F.count_if(ended & F.col("opened")) > F.count_if(ended))
    return features.groupBy("source").agg(_usual(F.count_if(F.col("plain"))).alias("loose"), untidy.alias("untidy"))


def _with_source(features: DataFrame, by_source: DataFrame) -> DataFrame:
    # one row per source; joined by hash with AQE, which sends it out only if it is small
    return features.join(by_source.withColumnRenamed("source", "habit_of"), F.col("source").eqNullSafe(F.col("habit_of")), "left").drop("habit_of")


def _plain(docs: DataFrame, text: str, features: DataFrame) -> DataFrame:
    """``features`` with plain: headlines whose last word is whole and whose length is below a limit of their source."""
    if not features.groupBy("source").agg(_usual(F.count_if(_unended())).alias("usual")).where("usual").limit(1).count():
        return features.withColumn("plain", F.lit(False))  # no source of headlines: no words to count
    # rows without a word to look up get keys of their own
    key = F.when(_unended() & (F.col("last") != ""), F.col("last")).otherwise(F.concat(F.lit("\0"), F.col("same").cast("string")))
    looked = features.withColumn("last", key).join(half_words(docs, text, features), "last", "left")
    looked = _with_source(looked, length_limits(features))
    return looked.withColumn("plain", F.coalesce(_unended() & F.col("half").isNull() & (F.col("limit").isNull() | (F.col("chars") < F.col("limit"))), F.lit(False)))


def judge(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, truncated, evidence) of every document.

    ``evidence`` is the first of: ``mark`` (a continuation mark), ``broken`` (half a character,
    escape or tag), ``open`` (the stack of tags, quotes and brackets is not empty, unless the source leaves
    it so in more than a quarter of its finished texts), ``unfinished`` (neither terminator nor closing line, nor a
    headline in a source of headlines); null if the text is whole.

    Defined cases: null and empty texts are not truncated; null sources form one source;
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    features = _plain(docs, text, _with_closing(cut(end_features(docs, doc, text, source))))
    joined = _with_source(features, source_habits(features))
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    finished = f("terminated") | f("closing_line")
    evidence = (
        F.when(F.col("empty") | F.col("empty").isNull(), F.lit(None).cast("string"))
        .when(f("marked"), "mark")
        .when(f("broken") & ~f("closing_line"), "broken")
        .when(f("opened") & ~f("untidy"), "open")
        .when(~finished & ~(f("loose") & f("plain")), "unfinished")
    )
    return joined.select("doc_id", "source", evidence.isNotNull().alias("truncated"), evidence.alias("evidence"))


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """(source, docs, truncated_docs, rate) of each source."""
    return judged.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("truncated")).alias("truncated_docs"), F.avg(F.col("truncated").cast("double")).alias("rate"))
