"""Rules over the shape of a text: lengths, runs, rhythm and repetition of sentences and paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.plans import model
from docaudit.plans.rules import Settings

LIMITS = {
    "max-sentence-length": (18, 25, 35),
    "sentence-rhythm": (35, 30, 20),
    "paragraph-length-variance": (40, 30, 20),
    "max-paragraph-length": (3, 5, 8),
    "one-sentence-paragraph-run": (3, 4, 6),
    "repeated-sentence-head": (2, 3, 4),
    "ngram-repetition": (3, 5, 9),
    "doubled-word": (1, 1, 1),
    "unbalanced-bracket": (1, 1, 1),
    "bracket-nesting": (1, 2, 3),
    "undefined-acronym": (1, 3, 6),
}


def sentence_too_long(docs: DataFrame, limit: int = 25) -> DataFrame:
    """doc_id, para, sent and n of sentences with more than `limit` words."""
    return model.sentences(docs).where(F.col("n_words") > limit).select("doc_id", "para", "sent", F.col("n_words").cast("bigint").alias("n"))


def _alike(sizes: DataFrame, place: list[str], limit: int, least: int) -> DataFrame:
    """doc_id, n and cv of documents with at least `least` sizes, in the order of their places, whose variation is below the limit."""
    each = sizes.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*place, "size"))).alias("sizes"))
    return each.where(F.col("n") >= least).select("doc_id", "n", T.variation(F.col("sizes.size")).alias("cv")).where(F.col("cv") < limit)


def sentence_rhythm(docs: DataFrame, limit: int = 30, least: int = 8) -> DataFrame:
    """doc_id, n and cv of documents whose sentences are alike in length: 100 times deviation over mean below the limit."""
    sizes = model.sentences(docs).select("doc_id", "para", "sent", F.length(F.regexp_replace("text", "\\s", "")).alias("size"))
    return _alike(sizes, ["para", "sent"], limit, least)


def paragraph_variance(docs: DataFrame, limit: int = 30, least: int = 9) -> DataFrame:
    """The same over paragraphs."""
    sizes = model.paragraphs(docs).select("doc_id", "para", F.length(F.regexp_replace("text", "\\s", "")).alias("size"))
    return _alike(sizes.where("size > 0"), ["para"], limit, least)


def paragraph_too_long(docs: DataFrame, limit: int = 5, full_sentence: int = 12) -> DataFrame:
    """doc_id, para and n of paragraphs with more sentences than the limit and more words than as many full ones have."""
    each = model.sentences(docs).groupBy("doc_id", "para").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))
    return each.where((F.col("n") > limit) & (F.col("n_words") > limit * full_sentence)).select("doc_id", "para", "n")


def one_sentence_runs(docs: DataFrame, limit: int = 4) -> DataFrame:
    """doc_id, first and n of runs of more than `limit` paragraphs of one sentence each."""
    each = model.sentences(docs).groupBy("doc_id", "para").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("para")
    ones = each.withColumn("island", F.row_number().over(order) - F.row_number().over(Window.partitionBy("doc_id", F.col("n") == 1).orderBy("para"))).where("n = 1")
    return ones.groupBy("doc_id", "island").agg(F.min("para").alias("first"), F.count("*").alias("n")).where(F.col("n") > limit).select("doc_id", "first", "n")


def doubled_words(docs: DataFrame) -> DataFrame:
    """doc_id, para, sent and word of words that stand twice in a row, whatever their case.

    Neighbours are compared as written but for case; a mark between them keeps them apart.
    """
    cut = model.sentences(docs).select("doc_id", "para", "sent", F.transform(T.words(F.col("text")), F.lower).alias("w")).where(F.size("w") > 1)
    at = lambda k: F.element_at("w", k)
    twice = F.filter(F.sequence(F.lit(2), F.size("w")), lambda k: (at(k) == at(k - 1)) & at(k).rlike("^\\p{L}+$"))
    return T.exploded(cut, ["doc_id", "para", "sent"], F.transform(twice, at), "word")


def repeated_heads(docs: DataFrame, limit: int = 2, head: int = 1) -> DataFrame:
    """doc_id, head and n of runs of more than `limit` sentences that open with the same `head` words."""
    cut = model.sentences(docs).withColumn("words", T.words(F.col("text"))).where(F.size("words") >= head)
    headed = cut.select("doc_id", "para", "sent", F.array_join(F.slice("words", 1, head), " ").alias("head"))
    order = Window.partitionBy("doc_id").orderBy("para", "sent")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("para", "sent"))
    return headed.withColumn("island", island).groupBy("doc_id", "head", "island").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("doc_id", "head", "n")


def repeated_grams(docs: DataFrame, size: int = 4, limit: int = 5, chars: int = 18) -> DataFrame:
    """doc_id, gram and n of word windows in more than `limit` sentences of a document; a sentence counts once.

    Windows are counted by hash in the document's own row; only texts of those that repeat are exchanged and counted
    anew. Rows are documents of their own.
    """
    sentences = F.flatten(F.transform(T.paragraphs(F.col("text")), T.sentences))
    cut = T.exploded(docs.where("text IS NOT NULL").select("doc_id", "text", F.monotonically_increasing_id().alias("row")), ["doc_id", "row"], F.array(F.filter(F.transform(sentences, T.bare_words), lambda w: F.size(w) >= size)), "s")
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - size + 1)
    hashed = T.exploded(cut, ["doc_id", "row", "s"], F.array(F.array_sort(F.flatten(F.transform("s", lambda w: F.array_distinct(F.transform(starts(w), lambda k: F.xxhash64(F.slice(w, k, size)))))))), "h")
    again = F.array_distinct(F.filter("h", lambda h, k: (k >= limit) & (F.get("h", k - limit) == h)))
    few = T.exploded(hashed, ["doc_id", "row", "s"], F.array(again), "again").where(F.size("again") > 0)
    each = T.exploded(few, ["doc_id", "row", "again"], F.col("s"), "w")
    grams = F.array_distinct(F.transform(F.filter(starts("w"), lambda k: F.array_contains("again", F.xxhash64(F.slice("w", k, size)))), lambda k: F.array_join(F.slice("w", k, size), " ")))
    found = T.exploded(each, ["doc_id", "row"], grams, "gram").where(F.length("gram") >= chars)
    return found.groupBy("doc_id", "row", "gram").agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("row")


#: Brackets that pair (fixed values).
PAIRS = ("()", "[]", "{}", "（）", "［］", "「」", "『』")


def unbalanced_brackets(docs: DataFrame) -> DataFrame:
    """doc_id, para and marks: the brackets of a paragraph that are left when each one that closes takes off its partner.

    A bracket that closes takes off the last one left, if that opens the same family; "( ]" and ")(" leave both.
    """
    marks = F.regexp_replace("text", "[^(){}\\[\\]（）［］「」『』]", "")
    last = lambda s: F.substring(s, -1, 1)
    left = F.aggregate(F.split("marks", ""), F.lit(""), lambda s, c: F.when((s != "") & F.concat(last(s), c).isin(*PAIRS), F.left(s, F.length(s) - 1)).otherwise(F.concat(s, c)))
    each = model.paragraphs(docs).select("doc_id", "para", marks.alias("marks")).where("marks <> ''")
    return each.select("doc_id", "para", left.alias("marks")).where("marks <> ''")


def bracket_nesting(docs: DataFrame, limit: int = 1) -> DataFrame:
    """doc_id, para and n of paragraphs with brackets more than `limit` deep."""
    depth = F.aggregate(
        F.split("marks", ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct((s["now"] + F.when(c == "(", 1).when((c == ")") & (s["now"] > 0), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "(", 1).otherwise(0)).alias("most")),
        lambda s: s["most"],
    )
    each = model.paragraphs(docs).withColumn("marks", F.regexp_replace("text", "[^()]", "")).where("marks LIKE '%(%(%'")
    return each.select("doc_id", "para", depth.cast("bigint").alias("n")).where(F.col("n") > limit)


def undefined_acronyms(docs: DataFrame, limit: int = 3, known: tuple[str, ...] = ("USA", "EU", "PDF", "URL", "HTML", "API", "FAQ", "CEO", "GNU", "MIT", "BSD", "THE")) -> DataFrame:
    """doc_id, n and acronyms of documents with at least `limit` capital runs that no bracket spells out."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("\\b[A-Z]{2,6}\\b"), F.lit(0)))
    spelled = F.array_distinct(F.regexp_extract_all("text", F.lit("\\(([A-Z]{2,6})\\)"), F.lit(1)))
    left = F.array_sort(F.array_except(F.array_except(found, spelled), F.array(*map(F.lit, known))))
    each = docs.where("text IS NOT NULL").select("doc_id", left.alias("a"))
    return each.where(F.size("a") >= limit).select("doc_id", F.size("a").cast("bigint").alias("n"), F.array_join("a", ",").alias("acronyms"))


def findings(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """These rules in the shape of findings, each document and rule once."""
    made = {
        "max-sentence-length": lambda k: sentence_too_long(docs, k),
        "sentence-rhythm": lambda k: sentence_rhythm(docs, k),
        "paragraph-length-variance": lambda k: paragraph_variance(docs, k),
        "max-paragraph-length": lambda k: paragraph_too_long(docs, k),
        "one-sentence-paragraph-run": lambda k: one_sentence_runs(docs, k),
        "repeated-sentence-head": lambda k: repeated_heads(docs, k),
        "ngram-repetition": lambda k: repeated_grams(docs, limit=k),
        "doubled-word": lambda k: doubled_words(docs),
        "unbalanced-bracket": lambda k: unbalanced_brackets(docs),
        "bracket-nesting": lambda k: bracket_nesting(docs, k),
        "undefined-acronym": lambda k: undefined_acronyms(docs, k),
    }
    frames = []
    for rule, build in made.items():
        limit = settings.limit(rule, LIMITS[rule])
        if limit is not None:
            each = build(limit).groupBy("doc_id").agg(F.count("*").alias("n"))
            frames.append(each.select("doc_id", F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), "n", F.lit(None).cast("string").alias("quote")))
    return reduce(DataFrame.unionByName, frames)
