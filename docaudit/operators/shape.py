"""The shape of documents: eleven measures of headings, sections, lists and labels, to hold against a measured corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import runs, tree

#: Openings and closings of documents, forms of headings and pairs of sides: defaults, any may be given.
OPENINGS = ("introduction", "overview", "background", "preface", "はじめに", "概要")
CLOSINGS = ("conclusion", "summary", "wrapping up", "final thoughts", "takeaways", "closing", "まとめ", "おわりに")
FORMS = (r"^how to ", r"^why ", r"^what (?:is|are) ", r"^the (?:role|importance|power|future) of ", r"^understanding ", r"とは$", r" (?:tips|guide|checklist)$")
SIDES = (("pros", "cons"), ("advantages", "disadvantages"), ("benefits", "drawbacks"), ("strengths", "weaknesses"), ("メリット", "デメリット"))
MEASURES = ("heading-density", "short-sections", "section-uniformity", "heading-forms", "three-subsections", "bookends", "closing-restatement", "three-item-lists", "bold-labels", "emoji-headings", "pro-con")
#: Least words, sections, headings and lists for what is a rate of them.
LEAST_WORDS, LEAST_SECTIONS, LEAST_SHORT, LEAST_HEADINGS, LEAST_BOOKENDS, LEAST_LISTS = 200, 5, 3, 4, 2, 3
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_LABEL = r"^[-*+ \t0-9.)]*(?:\*\*|__)([^*_\n]{1,60}?)[:：]?(?:\*\*|__)[ \t]*(?:[:：—–-]|$)"


def heading_words(text: Column) -> Column:
    """A heading in lower case without its decoration, number and closing marks."""
    bare = F.regexp_replace(F.lower(F.trim(text)), rf"^(?:{EMOJI}|\x{{FE0F}}|\x{{200D}})+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^第?[0-9]+(?:[.-][0-9]+)*(?:[章節.)、:：]|(?=\s))\s*", ""), r"[\s?？!！。.:：]+$", ""))


def sections(docs: DataFrame) -> DataFrame:
    """row, doc_id, section (0 before the first heading), depth, title, emoji, paragraphs, words, grams (hashes of word pairs), listed (run and indent of its list items), bold and labels of each section."""
    # Sections, lists and labels come of one reading of the lines.
    each = runs.runs(docs, F.lit(True)).withColumnRenamed("kind", "run_kind")
    so_far = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("text").rlike(tree.HEADING)
    prose = ~heading & (F.trim("text") != "") & ~F.col("text").rlike(r"^\s*(?:\||>|:::|[-*_]{3,}\s*$)")
    item = prose & F.col("text").rlike(runs.LIST_ITEM)
    each = each.withColumns({"heading": heading, "prose": prose, "section": F.count_if(heading).over(so_far)})
    starts = F.col("prose") & ~item & ~F.coalesce(F.lag("prose").over(Window.partitionBy("row").orderBy("line")), F.lit(False))
    each = each.withColumns({"starts": starts, "w": F.when(F.col("prose"), T.bare_words(F.regexp_replace("text", runs.LIST_ITEM, "")))})
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.xxhash64(F.slice("w", k, 2))))
    own = each.withColumns({"pairs": pairs, "labelled": F.col("text").rlike(_LABEL)}).groupBy("row", "doc_id", "section").agg(
        F.max(F.when(F.col("heading"), F.length(F.regexp_extract("text", tree.HEADING, 1)))).alias("depth"), F.max(F.when(F.col("heading"), heading_words(F.regexp_extract("text", tree.HEADING, 2)))).alias("title"),
        F.max(F.col("heading") & F.col("text").rlike(EMOJI)).alias("emoji"), F.count_if("starts").alias("paragraphs"), F.sum(F.coalesce(F.size("w"), F.lit(0))).alias("words"), F.flatten(F.collect_list("pairs")).alias("grams"),
        F.collect_list(F.when(F.col("run_kind") == "list", F.struct("run", "indent"))).alias("listed"), F.count_if(F.col("labelled") & F.col("text").rlike(runs.LIST_ITEM)).alias("bold"), F.collect_set(F.when(F.col("labelled"), heading_words(F.regexp_extract("text", _LABEL, 1)))).alias("labels"),
    )
    return own.withColumn("words", F.greatest("words", F.lit(0)))


def _starts(title: Column, words: tuple[str, ...]) -> Column:
    return title.rlike("^(?:" + "|".join(words) + r")(?![a-z])")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, row and a column for each of MEASURES; null where a document is too short for one. Null texts have no row.

    Of the headings the first is left out if it is the only kind of its depth, 1: a title. Densities are a thousand
    words', shares and variation per cent, the rest counts. A section's arrays are those of one document.
    """
    s = sections(docs)
    packed = s.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "depth", "title", "emoji", "paragraphs", "words", "grams"))).alias("all"), F.array_sort(F.flatten(F.collect_list("listed"))).alias("items"), F.sum("bold").alias("bold"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    headed = F.filter("all", lambda x: x["section"] > 0)
    packed = packed.withColumn("headed", headed)
    titled = F.coalesce(F.get("headed", F.lit(0))["depth"] == 1, F.lit(False))
    packed = packed.withColumn("h", F.when(titled, F.slice("headed", F.lit(2), F.greatest(F.size("headed") - 1, F.lit(0)))).otherwise(F.col("headed")))
    packed = T.exploded(packed, ["row", "doc_id", "all", "headed", "items", "bold", "labels"], F.array("h"), "h")
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    share = lambda part, whole: F.round(part * 100.0 / whole).cast("double")
    n = F.size("h")
    spoken = F.filter("h", lambda x: x["words"] > 0)
    lengths = F.transform(F.filter("all", lambda x: x["words"] > 0), lambda x: x["words"].cast("double"))
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.size(lengths)
    spread = F.sqrt(F.aggregate(F.transform(lengths, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / F.size(lengths))
    body = F.filter("h", lambda x: ~_starts(x["title"], (*OPENINGS, *CLOSINGS)))
    formed = F.filter(body, lambda x: x["title"].rlike("|".join(FORMS)))

    def children(x: Column, k: Column) -> Column:
        """Subsections one level under a section, up to the next that is no deeper."""
        after = F.slice("h", k + 2, F.greatest(F.size("h") - k - 1, F.lit(0)))
        end = F.array_position(F.transform(after, lambda y: y["depth"] <= x["depth"]), F.lit(True)).cast("int")
        return F.size(F.filter(F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after), lambda y: y["depth"] == x["depth"] + 1))

    threes = F.size(F.filter(F.transform("h", children), lambda c: c == 3))
    opens, closes = (F.exists("h", lambda x: _starts(x["title"], OPENINGS)), F.exists("h", lambda x: _starts(x["title"], CLOSINGS)))
    last = F.try_element_at(F.filter(spoken, lambda x: _starts(x["title"], CLOSINGS)), F.lit(-1))
    before = F.flatten(F.transform(F.filter("all", lambda x: x["section"] < last["section"]), lambda x: x["grams"]))
    said = F.array_distinct(last["grams"])
    restated = F.when(F.size(said) > 0, share(F.size(F.array_intersect(said, before)), F.size(said)))
    # Items of one list stand side by side in order.
    item = lambda k: F.get("items", k)
    first = lambda k: ~item(k - 1).eqNullSafe(item(k))
    measured = packed.select(
        "row", "doc_id",
        F.when(total >= LEAST_WORDS, F.round(n * 1000.0 / total, 1)).alias("heading-density"),
        F.when(F.size(spoken) >= LEAST_SHORT, share(F.size(F.filter(spoken, lambda x: x["paragraphs"] <= 2)), F.size(spoken))).alias("short-sections"),
        F.when((F.size(lengths) >= LEAST_SECTIONS) & (mean > 0), F.round(spread * 100 / mean)).alias("section-uniformity"),
        F.when(F.size(body) >= LEAST_HEADINGS, share(F.size(formed), F.size(body))).alias("heading-forms"),
        threes.cast("double").alias("three-subsections"),
        F.when(n >= LEAST_BOOKENDS, (opens.cast("int") + closes.cast("int")).cast("double")).alias("bookends"),
        restated.alias("closing-restatement"),
        F.size(F.filter("headed", lambda x: x["emoji"])).cast("double").alias("emoji-headings"),
        F.transform("h", lambda x: x["title"]).alias("titles"), "labels", "bold",
        F.size(F.filter("items", lambda x, k: first(k))).alias("lists"), F.size(F.filter("items", lambda x, k: first(k) & (item(k + 2) == x) & ~item(k + 3).eqNullSafe(x))).alias("threes"),
    )
    names = F.concat("titles", "labels")

    def both(pro: str, con: str) -> Column:
        """Whether one name has the good side, apart from the bad side's word, and another has the bad side."""
        good, bad = F.filter(names, lambda x: F.replace(x, F.lit(con), F.lit(" ")).rlike(rf"(?<![a-z]){pro}(?![a-z])")), F.filter(names, lambda x: x.rlike(rf"(?<![a-z]){con}(?![a-z])"))
        alone = (F.size(good) == 1) & (F.size(bad) == 1) & (F.get(good, F.lit(0)) == F.get(bad, F.lit(0)))
        return F.when((F.size(good) > 0) & (F.size(bad) > 0) & ~F.coalesce(alone, F.lit(False)), 1).otherwise(0)

    pairs = sum((both(*x) for x in SIDES), F.lit(0))
    return measured.withColumns({
        "three-item-lists": F.when(F.col("lists") >= LEAST_LISTS, share(F.col("threes"), F.col("lists"))), "bold-labels": F.col("bold").cast("double"),
        "pro-con": F.when(F.size("titles") >= LEAST_BOOKENDS, pairs.cast("double")),
    }).select("doc_id", "row", *(F.col(f"`{m}`") for m in MEASURES))
