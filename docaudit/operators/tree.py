"""The structure of numbered documents as a table of nodes: parts, chapters, articles, items and headings.

Every line that opens a unit has a rank; the outermost is least. A unit's parent is the nearest line before it with a
lower rank, and it ends before the next line with no higher one: what a stack would hold at a line are, rank by rank,
the last lines before it that no outer unit has closed since. So one pass of windows over the lines of a document
gives every node its ancestors, address and end. Mentions (references, definitions, obligations, amounts, dates) are
leaves of the unit that is open on their line.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docaudit.functions import text as T
from docaudit.operators import masking

#: Ranks: headings by depth, parts, chapters, articles and sections by the parts of their number, items by style.
PART, CHAPTER, ARTICLE, ITEM = 7, 8, 10, 16
#: Styles of items in brackets: (a), (i), (1), (A). Under one unit they nest in the order in which they first occur.
STYLES = ("letter", "roman", "number", "capital")
RANKS = tuple(range(1, ITEM + len(STYLES) + 1))
_DOTTED = r"[0-9]{1,3}(?:\.[0-9]{1,3}){0,5}"
_ROMAN = r"[IVXLC]{1,7}"
#: A number in one of these forms opens an article; behind it stands nothing, a mark or a title in capitals.
ARTICLES = (rf"^\s{{0,3}}(?:ARTICLE|Article)\s+([0-9]{{1,3}}|{_ROMAN})\b(.*)$", rf"^\s{{0,3}}(?:SECTION|Section|Sec\.|§)\s*({_DOTTED})\b\.?(.*)$")
CHAPTERS = (rf"^\s{{0,3}}(?:PART|Part)\s+([0-9]{{1,3}}|{_ROMAN})\b(.*)$", rf"^\s{{0,3}}(?:CHAPTER|Chapter)\s+([0-9]{{1,3}}|{_ROMAN})\b(.*)$")
#: "4.2 Payment": two parts at least, or one on a heading.
NUMBERED = r"^ {0,3}([0-9]{1,3}(?:\.[0-9]{1,3}){0,5})[.]?[ \t]+(\S.*)$"
BRACKETED = r"^\s{0,12}\(([a-z]{1,4}|[A-Z]{1,2}|[0-9]{1,3})\)\s+(\S.*)$"
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
#: "Section 4.2(a)(ii)", "Article IV".
REFERENCE = rf"\b(?:Sections?|Articles?|§)\s*({_DOTTED}|{_ROMAN}\b)((?:\([A-Za-z0-9]{{1,4}}\))*)"
#: Behind a reference: it names a unit of another document.
ELSEWHERE = r"^[\s,]*(?:of|in|to|under)\s+(?:the\s+)?(?:[A-Z][\w.&'-]*\s+){0,6}(?:Act|Code|Law|Regulations?|Treaty|Directive|Statute|Constitution|Rules|U\.S\.C|GDPR)\b"
LEAVES = {
    "definition": r"[\"“]([A-Z][^\"”\n]{0,60})[\"”]\s+(?:means|shall mean|has the meaning|refers to)|\((?:the|each,? an?|collectively,? the)?\s*[\"“]([A-Z][^\"”\n]{0,60})[\"”]\)",
    "obligation": r"\b(?:shall|must|is required to|are required to|agrees? to)\b",
    "quantity": r"(?:[$€£¥]\s?[0-9][0-9,]*(?:\.[0-9]+)?|\b[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:%|percent\b|days?\b|months?\b|years?\b|hours?\b|kg\b|km\b|USD\b|EUR\b))",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}\b|\b[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}\b",
}


def roman_value(raw: Column) -> Column:
    """The number that a roman numeral of I, V, X, L, C writes, in either case; null for other texts."""
    letters = F.array_compact(F.transform(F.split(F.upper(raw), ""), lambda c: F.element_at(F.create_map(*map(F.lit, ("I", 1, "V", 5, "X", 10, "L", 50, "C", 100))), c)))
    total = F.aggregate(F.reverse(letters), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, x: F.struct((s["sum"] + F.when(x < s["last"], -x).otherwise(x)).alias("sum"), F.greatest(x, s["last"]).alias("last")), lambda s: s["sum"])
    return F.when(raw.rlike("(?i)^[IVXLC]+$"), total)


def _arabic(raw: Column) -> Column:
    return F.when(raw.rlike("^[0-9.]+$"), raw).otherwise(roman_value(raw).cast("string"))


def lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, line (from 1), start and text of every line of the texts there are, code blanked."""
    # Texts are dealt, not their lines: what is cut from a text stays where its row is, and windows by row exchange nothing.
    dealt = docs.where("text IS NOT NULL").select("doc_id", F.monotonically_increasing_id().alias("row"), "text").repartition(T.shares(docs), "row")
    cut = T.exploded(dealt, ["row", "doc_id"], F.split(masking.without_code(T.plain(F.col("text"))), "\n", -1), "text", "line").withColumn("line", F.col("line") + 1)
    end = F.sum(F.length("text") + 1).over(_so_far())
    return cut.withColumn("start", (end - F.length("text") - 1).cast("int"))


def _so_far() -> Window:
    return Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def _titled(rest: Column) -> Column:
    """What stands behind a number, without marks between; null where it goes on as a sentence, which is no unit's start."""
    trimmed = F.trim(F.regexp_replace(rest, r"^[.:\s–—-]+", ""))
    return F.when(~rest.rlike(r"^\s*,") & ~trimmed.rlike(r"^\p{Ll}"), trimmed)


def _openings(each: DataFrame) -> DataFrame:
    """Lines with opens: the unit that starts there - rank, kind, number, absolute, label, heading, ordinal - or null."""
    text, heading = F.col("text"), F.col("text").rlike(HEADING)
    words = F.when(heading, F.regexp_extract("text", HEADING, 2)).otherwise(text)
    each = each.withColumns({"is_heading": heading, "words": words, "depth": F.when(heading, F.length(F.regexp_extract("text", HEADING, 1)))})
    words = F.col("words")

    def unit(rank: Column, kind: str, number: Column, absolute: bool, label: Column, title: Column, ordinal: Column) -> Column:
        ranked = F.when(F.col("is_heading"), F.col("depth")).otherwise(rank)
        return F.struct(ranked.cast("int").alias("rank"), F.lit(kind).alias("kind"), number.alias("number"), F.lit(absolute).alias("absolute"), label.alias("label"), title.alias("heading"), ordinal.cast("int").alias("ordinal"))

    units = []
    for pattern, rank, prefix in ((CHAPTERS[0], PART, "pt"), (CHAPTERS[1], CHAPTER, "ch")):
        n, title = _arabic(F.regexp_extract(words, pattern, 1)), _titled(F.regexp_extract(words, pattern, 2))
        label = F.regexp_extract(words, r"^\s*(\w+\s+\w+)", 1)
        units.append(F.when(words.rlike(pattern) & n.isNotNull() & title.isNotNull(), unit(F.lit(rank), "chapter", F.concat(F.lit(prefix), n), False, label, title, n)))
    for pattern in ARTICLES:
        n, title = _arabic(F.regexp_extract(words, pattern, 1)), _titled(F.regexp_extract(words, pattern, 2))
        parts = F.split(n, r"\.")
        label = F.trim(F.regexp_extract(words, r"^\s*((?:[A-Za-z]+\.?|§)\s*[0-9IVXLC.]*[0-9IVXLC])", 1))
        units.append(F.when(words.rlike(pattern) & n.isNotNull() & title.isNotNull(), unit(F.lit(ARTICLE - 1) + F.size(parts), "article", n, True, label, title, F.element_at(parts, -1))))
    n = F.regexp_extract(words, NUMBERED, 1)
    parts = F.split(n, r"\.")
    counted = F.regexp_extract(words, NUMBERED, 2).rlike(r"^(?:%|percent|days?|months?|years?|hours?|kg|km|[a-z])")
    units.append(F.when(words.rlike(NUMBERED) & ((F.size(parts) > 1) | F.col("is_heading")) & ~counted, unit(F.lit(ARTICLE - 1) + F.size(parts), "article", n, True, n, F.regexp_extract(words, NUMBERED, 2), F.element_at(parts, -1))))
    units.append(F.when(F.col("is_heading"), unit(F.col("depth"), "section", F.lit(None).cast("string"), True, F.lit(""), words, F.lit(None))))
    each = each.withColumn("opens", F.coalesce(*units))
    # Items: of (i), (v) and (x) the letters before decide whether they go on with them.
    raw = F.when(F.col("opens").isNull() & text.rlike(BRACKETED), F.regexp_extract("text", BRACKETED, 1))
    before = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("raw", raw)
    each = each.withColumn("letter", F.when(F.col("raw").rlike("^[a-z]$") & ~F.col("raw").isin("i", "v", "x"), F.col("raw")))
    last = F.last("letter", True).over(before)
    follows = F.coalesce((F.ascii(last) + 1 == F.ascii("raw")) & (F.last("raw", True).over(before) == last), F.lit(False))
    style = F.when(F.col("raw").rlike("^[0-9]+$"), "number").when(F.col("raw").rlike("^[A-Z]+$"), "capital").when(F.col("raw").rlike("^[ivxlc]+$") & (F.length("raw") > 1), "roman").when(F.col("raw").isin("i", "v", "x") & ~follows, "roman").otherwise("letter")
    each = each.withColumn("style", F.when(F.col("raw").isNotNull(), style))
    ordinal = F.when(F.col("style") == "number", F.col("raw").try_cast("int")).when(F.col("style") == "roman", roman_value(F.col("raw"))).otherwise(F.ascii(F.lower("raw")) - 96)
    each = each.withColumn("unit", F.count("opens").over(_so_far()))
    firsts = {f"first_{s}": F.min(F.when(F.col("style") == s, F.col("line"))).over(Window.partitionBy("row", "unit")) for s in STYLES}
    each = each.withColumns(firsts)
    own = F.coalesce(*(F.when(F.col("style") == s, F.col(f"first_{s}")) for s in STYLES))
    rank = ITEM + sum((F.when(F.col(f"first_{s}") <= own, 1).otherwise(0) for s in STYLES), F.lit(0))
    item = F.when(F.col("raw").isNotNull(), unit(rank, "item", F.col("raw"), False, F.concat(F.lit("("), "raw", F.lit(")")), F.lit(""), ordinal))
    return each.withColumn("opens", F.coalesce("opens", item)).drop("raw", "letter", "style", "unit", *firsts)


def outline(depths: list[int], ranks: list[int], numbers: list[str | None], absolute: list[bool]) -> list[tuple[int, int, str | None]]:
    """(parent, next, address) of each of a document's units in order: places in the list, -1 for none.

    The parent is the nearest unit before with a lower rank, next the first one behind with no higher rank. Headings
    without a number count those of each depth since the last less deep one.
    """
    found: list[list] = [[-1, -1, None] for _ in ranks]
    counts = [0] * 7
    stack: list[tuple[int, int, str | None, str | None]] = []
    for k, (depth, rank, number, own) in enumerate(zip(depths, ranks, numbers, absolute)):
        counted = None
        if depth:
            counts[depth] += 1
            counts[depth + 1 :] = [0] * (6 - depth)
            counted = "h" + ".".join(map(str, counts[1 : depth + 1]))
        while stack and stack[-1][0] >= rank:
            found[stack.pop()[1]][1] = k
        _, found[k][0], numbered, section = stack[-1] if stack else (0, -1, None, None)
        if number is None:
            section = found[k][2] = counted
        else:
            before = numbered + "." if numbered is not None else section + "/" if section is not None else ""
            numbered = found[k][2] = number if own else before + number
        stack.append((rank, k, numbered, section))
    return [tuple(x) for x in found]


@F.pandas_udf(StructType([StructField("parent", ArrayType(IntegerType())), StructField("next", ArrayType(IntegerType())), StructField("address", ArrayType(StringType()))]))
def _outlines(depths: pd.Series, ranks: pd.Series, numbers: pd.Series, absolute: pd.Series) -> pd.DataFrame:
    """outline() of each document's units, each part of it an array."""
    found = [outline(list(a), list(b), list(c), list(d)) for a, b, c, d in zip(depths, ranks, numbers, absolute)]
    return pd.DataFrame({name: [[x[k] for x in units] for units in found] for k, name in enumerate(("parent", "next", "address"))})


def _outlined(each: DataFrame, **more: Column) -> DataFrame:
    """doc_id, row, units (in order, each with what outline() says), doc_end and other aggregates of each document of lines with what they open."""
    end = F.struct(F.col("line"), (F.col("start") + F.length("text")).alias("end"))
    before = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.trim("text") != "", end)
    each = each.withColumns({"written": written, "last_written": F.last(written, True).over(before)})
    unit = F.struct("line", "start", "opens", "depth", "last_written")
    packed = each.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("opens").isNotNull(), unit))).alias("units"), F.max("written").alias("doc_end"), *(c.alias(n) for n, c in more.items()))
    # A heading's depth is 0 for none: arrays with nulls come to pandas as other numbers.
    depths = F.transform("units", lambda u: F.coalesce(u["depth"], F.lit(0)))
    return packed.withColumn("outline", _outlines(depths, F.col("units.opens.rank"), F.col("units.opens.number"), F.col("units.opens.absolute")))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, row, line, parent (line of the unit around it, 0 for the document), kind, rank, address, label, heading, ordinal, start, end and last of every unit.

    start and end are places in the text without byte order mark and carriage returns, last is the last written line.
    Null texts have none, the empty text neither; repeated rows have trees of their own, told apart by row. docs is a
    stored table, or gives its rows in one order whenever it is read. A document's units are gathered in a row.
    """
    each = _outlined(_openings(lines(docs)))
    both = F.transform(F.arrays_zip(F.col("units").alias("unit"), F.col("outline.parent").alias("parent"), F.col("outline.next").alias("next"), F.col("outline.address").alias("address")), lambda x: F.struct(
        x["unit"].alias("unit"), x["address"].alias("address"), F.coalesce(F.get("units", x["parent"])["line"], F.lit(0)).alias("parent"),
        F.when(x["next"] < 0, F.col("doc_end")).otherwise(F.get("units", x["next"])["last_written"]).alias("until"),
    ))
    found = T.exploded(each, ["doc_id", "row"], both, "u").select("doc_id", "row", "u.*")
    return found.select("doc_id", "row", "unit.line", "parent", "unit.opens.kind", "unit.opens.rank", "address", "unit.opens.label", "unit.opens.heading", "unit.opens.ordinal", "unit.start", F.col("until.end").alias("end"), F.col("until.line").alias("last"))


def _read(each: DataFrame) -> DataFrame:
    """Adds skip, the length of a unit's own label at the head of its line, and read, what stands behind it."""
    label = F.when(F.col("opens.kind").isin("article", "chapter") & (F.col("opens.label") != ""), F.instr("text", F.col("opens.label")) + F.length("opens.label") - 1).otherwise(0)
    return each.withColumn("skip", F.greatest(label, F.lit(0)).cast("int")).withColumn("read", F.substring("text", F.col("skip") + 1, F.length("text")))


def _pieces(pattern: str) -> Column:
    """What stands in read before each match of the pattern, and the match; the last has none."""
    return F.zip_with(F.split("read", F.lit(pattern), -1), F.regexp_extract_all("read", F.lit(pattern), F.lit(0)), lambda p, q: F.struct(p.alias("before"), q.alias("quote")))


def _made(kind: str) -> Column:
    """Of pieces each match: at (its place in read), quote and target."""
    # A line holds a few mentions; the pieces before one say where it is.
    nth = F.sequence(F.lit(1), F.size("pieces") - 1)
    length = lambda x: F.length(x["before"]) + F.coalesce(F.length(x["quote"]), F.lit(0))
    place = lambda k: F.aggregate(F.slice("pieces", F.lit(1), k - 1), F.lit(0), lambda s, x: s + length(x))

    def target(quote: Column, behind: Column) -> Column:
        if kind != "reference":
            return F.lit(None).cast("string")
        number = _arabic(F.regexp_extract(quote, REFERENCE, 1))
        items = F.regexp_extract_all(quote, F.lit(r"\(([A-Za-z0-9]{1,4})\)"), F.lit(1))
        return F.when(~behind.rlike(ELSEWHERE), F.array_join(F.concat(F.array(number), items), "."))

    def match(k: Column) -> Column:
        quote = F.element_at("pieces", k)["quote"]
        return F.struct((place(k) + F.length(F.element_at("pieces", k)["before"])).alias("at"), quote.alias("quote"), target(quote, F.element_at("pieces", k + 1)["before"]).alias("target"))

    return F.transform(nth, match)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, row, line, parent (line of the innermost open unit, 0 for none), kind, start, end, quote and target of mentions.

    target is the address that a reference names, null for the rest and for references into other documents. A unit's
    own label is no reference.
    """
    each = _openings(lines(docs)).withColumn("parent", F.coalesce(F.last(F.when(F.col("opens").isNotNull(), F.col("line")), True).over(_so_far()), F.lit(0)))
    each, found = _read(each), None
    for kind, pattern in {"reference": REFERENCE, **LEAVES}.items():
        keep = ["doc_id", "row", "line", "parent", "start", "skip"]
        own = each.where(F.col("read").rlike(pattern)).select(*keep, _pieces(pattern).alias("pieces"))
        start = F.col("start") + F.col("skip") + F.col("m.at")
        hit = T.exploded(own, keep, _made(kind), "m").select("doc_id", "row", "line", "parent", F.lit(kind).alias("kind"), start.alias("start"), (start + F.length("m.quote")).alias("end"), "m.quote", "m.target")
        found = hit if found is None else found.unionByName(hit)
    return found


def dangling_references(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, end, quote and target of references to an address that the document does not have.

    Documents without a numbered unit are not judged, nor are references into other documents. Units and references
    come of one reading of the lines.
    """
    each = _read(_openings(lines(docs))).withColumn("pieces", F.when(F.col("read").rlike(REFERENCE), _pieces(REFERENCE)))
    start = F.col("start") + F.col("skip")
    hits = F.when(F.col("pieces").isNotNull(), F.transform(_made("reference"), lambda m: F.struct("line", (start + m["at"]).alias("start"), (start + m["at"] + F.length(m["quote"])).alias("end"), m["quote"].alias("quote"), m["target"].alias("target"))))
    packed = _outlined(each.withColumn("hits", hits), asked=F.flatten(F.collect_list("hits"))).where(F.size("asked") > 0)
    numbered = F.filter(F.arrays_zip(F.col("units.opens.kind").alias("kind"), F.col("outline.address").alias("address")), lambda x: x["kind"] != "section")
    there = F.transform(numbered, lambda x: x["address"])
    missing = T.exploded(packed.withColumn("there", there).where(F.size("there") > 0), ["doc_id", "asked"], F.array(F.array_except(F.transform("asked", lambda x: x["target"]), F.col("there"))), "missing")
    found = F.filter("asked", lambda x: x["target"].isNotNull() & F.array_contains("missing", x["target"]))
    return T.exploded(missing.where(F.size("missing") > 0), ["doc_id"], found, "f").select("doc_id", "f.line", "f.start", "f.end", "f.quote", "f.target")


def rendered(docs: DataFrame) -> DataFrame:
    """doc_id and tree: one line a unit, indented by its depth, with kind, address and label."""
    each = nodes(docs)
    depth = F.col("rank")
    lines_ = F.array_sort(F.collect_list(F.struct("line", depth.alias("rank"), F.concat_ws(" ", "kind", "address", "label", "heading").alias("said"))))
    return each.groupBy("row", "doc_id").agg(F.array_join(F.transform(lines_, lambda x: F.concat(F.repeat(F.lit(" "), x["rank"]), F.trim(x["said"]))), "\n").alias("tree")).drop("row")
