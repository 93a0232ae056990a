"""Markdown structure as tables, and the rules over headings, lists, tables, links, images and fences.

A document is cut into numbered lines; a running count of fences tells code from text. All in built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text and in_code of every line; fence lines count as code."""
    cut = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(T.plain(F.col("text")), "\n", -1)).alias("line", "text"))
    fence = F.col("text").rlike("^ {0,3}(```|~~~)")
    before = F.sum(fence.cast("int")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    each = cut.withColumns({"line": F.col("line") + 1, "fence": fence, "fences": before})
    return each.withColumn("in_code", F.col("fence") | (F.col("fences") % 2 == 1))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line, depth and text of ATX headings outside code."""
    found = lines(docs).where(~F.col("in_code") & F.col("text").rlike("^#{1,6}\\s"))
    return found.select("doc_id", "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("depth"), F.trim(F.regexp_replace(F.regexp_replace("text", "^#+\\s+", ""), "\\s#+\\s*$", "")).alias("text"))


def list_items(docs: DataFrame) -> DataFrame:
    """doc_id, line, list (number of its run), marker, number and text of list items."""
    pattern = "^\\s*([-*+]|[0-9]+[.)])\\s+(.*)$"
    own = lines(docs).where(~F.col("in_code")).withColumn("item", F.col("text").rlike("^\\s*([-*+]|[0-9]+[.)])(\\s|$)"))
    breaks = F.sum((~F.col("item") & (F.trim("text") != "")).cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    found = own.withColumn("list", breaks).where("item")
    marker = F.regexp_extract("text", "^\\s*([-*+]|[0-9]+[.)])", 1)
    return found.select("doc_id", "line", "list", marker.alias("marker"), F.try_to_number(F.regexp_extract(marker, "([0-9]{1,9})", 1), F.lit("999999999")).cast("int").alias("number"), F.trim(F.regexp_extract("text", pattern, 2)).alias("text"))


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, tbl, row (header is 0), col (from 1) and text of the cells of pipe tables."""
    own = lines(docs).where(~F.col("in_code")).withColumn("piped", F.col("text").rlike("^\\s*\\|.*\\|\\s*$"))
    runs = F.sum((~F.col("piped")).cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    rows = own.withColumn("tbl", runs).where("piped")
    ruled = rows.withColumn("rule", F.col("text").rlike("^\\s*\\|[\\s:|-]+\\|\\s*$"))
    numbered = ruled.where("NOT rule").withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("line")) - 1)
    inner = F.regexp_replace(F.trim("text"), "^\\||\\|$", "")
    return numbered.select("doc_id", "tbl", "line", "row", F.posexplode(F.split(inner, "(?<!\\\\)\\|", -1)).alias("col", "text")).withColumns({"col": F.col("col") + 1, "text": F.trim("text")})


def links(docs: DataFrame) -> DataFrame:
    """doc_id, line, image, text and target of inline links and images outside code."""
    all_ = F.regexp_extract_all("text", F.lit("(!?\\[[^\\]\\n]*\\]\\([^)\\s]*\\))"), F.lit(1))
    found = lines(docs).where(~F.col("in_code")).select("doc_id", "line", F.explode(all_).alias("raw"))
    return found.select("doc_id", "line", F.col("raw").startswith("!").alias("image"), F.regexp_extract("raw", "\\[([^\\]]*)\\]", 1).alias("text"), F.regexp_extract("raw", "\\]\\(([^)]*)\\)", 1).alias("target"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s-]", ""), "\\s", "-")


def _in_order(column: str = "line"):
    return Window.partitionBy("doc_id").orderBy(column)


def heading_level_skip(docs: DataFrame) -> DataFrame:
    """Headings more than one level under the one before."""
    return headings(docs).withColumn("before", F.lag("depth").over(_in_order())).where("depth - before > 1").select("doc_id", "line", F.col("text").alias("quote"))


def empty_section(docs: DataFrame) -> DataFrame:
    """Headings with nothing under them before the next of the same or a higher level, or the end."""
    heads = headings(docs).select("doc_id", F.col("line").alias("head"), "depth", F.col("text").alias("quote"))
    body = lines(docs).where(F.trim("text") != "").select("doc_id", "line")
    following = heads.withColumns({"next": F.lead("head").over(_in_order("head")), "next_depth": F.lead("depth").over(_in_order("head"))})
    bodies = body.join(following, "doc_id").where((F.col("line") > F.col("head")) & (F.col("next").isNull() | (F.col("line") < F.col("next")))).select("doc_id", "head").distinct()
    return following.join(bodies, ["doc_id", "head"], "left_anti").where("next IS NULL OR next_depth <= depth").select("doc_id", F.col("head").alias("line"), "quote")


def duplicate_heading(docs: DataFrame) -> DataFrame:
    """The second and later of headings with the same words under the same parent."""
    heads = headings(docs)
    parents = heads.select("doc_id", F.col("line").alias("above"), F.col("depth").alias("above_depth"))
    joined = heads.join(parents, "doc_id", "left").where("above IS NULL OR above < line OR above = line")
    parent = F.max(F.when((F.col("above") < F.col("line")) & (F.col("above_depth") < F.col("depth")), F.col("above"))).alias("parent")
    each = joined.groupBy("doc_id", "line", "depth", "text").agg(parent)
    nth = F.row_number().over(Window.partitionBy("doc_id", F.coalesce("parent", F.lit(0)), F.lower("text")).orderBy("line"))
    return each.withColumn("nth", nth).where("nth > 1").select("doc_id", "line", F.col("text").alias("quote"))


def title_length(docs: DataFrame, limit: int = 14) -> DataFrame:
    return headings(docs).where(F.size(T.words(F.col("text"))) > limit).select("doc_id", "line", F.col("text").alias("quote"))


def numbering_gap(docs: DataFrame) -> DataFrame:
    """Numbered items whose number is not one more than the one before in their list."""
    own = list_items(docs).where("number IS NOT NULL")
    before = F.lag("number").over(Window.partitionBy("doc_id", "list").orderBy("line"))
    return own.withColumn("before", before).where("number <> before + 1 AND NOT (number = before)").select("doc_id", "line", F.col("text").alias("quote"))


def empty_list_item(docs: DataFrame) -> DataFrame:
    return list_items(docs).where((F.col("text") == "") | F.col("text").rlike("^[^:]{1,40}:$")).select("doc_id", "line", F.col("text").alias("quote"))


def announced_count_mismatch(docs: DataFrame) -> DataFrame:
    """A line that announces a number of items, right before a list of another length."""
    words = ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    number = F.lower(F.regexp_extract("text", "(?i)\\b(" + "|".join(words) + "|[2-9]|10)\\b[^.:]*:\\s*$", 1))
    value = F.coalesce(*(F.when(number == w, k) for k, w in enumerate(words, 2)), F.expr("try_cast(nullif(" + "'', '') AS int)"))
    said = lines(docs).where(~F.col("in_code")).withColumn("said", F.coalesce(value, F.when(number.rlike("^[0-9]+$"), number.try_cast("int"))))
    items = list_items(docs).groupBy("doc_id", "list").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    joined = said.where("said IS NOT NULL").join(items, "doc_id").where((F.col("first") > F.col("line")) & (F.col("first") - F.col("line") <= 2) & (F.col("n") != F.col("said")))
    return joined.select("doc_id", "line", F.trim("text").alias("quote"))


def table_row_overflow(docs: DataFrame) -> DataFrame:
    """Rows with more cells than their table's header."""
    widths = table_cells(docs).groupBy("doc_id", "tbl", "row", "line").agg(F.count("*").alias("n"))
    head = widths.where("row = 0").select("doc_id", "tbl", F.col("n").alias("header"))
    return widths.join(head, ["doc_id", "tbl"]).where("n > header").select("doc_id", "line", F.col("n").cast("string").alias("quote"))


def empty_table_cell(docs: DataFrame) -> DataFrame:
    """The one blank cell of a column whose other rows (two at least) are filled."""
    body = table_cells(docs).where("row > 0")
    column = Window.partitionBy("doc_id", "tbl", "col")
    each = body.withColumns({"blank": F.count_if(F.col("text") == "").over(column), "n": F.count("*").over(column)})
    return each.where("text = '' AND blank = 1 AND n >= 3").select("doc_id", "line", F.col("col").cast("string").alias("quote"))


def number_without_unit(docs: DataFrame) -> DataFrame:
    """A bare number in a column where all other cells (two at least) carry the same unit."""
    body = table_cells(docs).where("row > 0").withColumn("unit", F.regexp_extract("text", "^[0-9][0-9.,]*\\s*([^0-9.,\\s].*)$", 1))
    column = Window.partitionBy("doc_id", "tbl", "col")
    bare = F.col("text").rlike("^[0-9][0-9.,]*$")
    each = body.withColumns({"bare": bare, "bares": F.count_if(bare).over(column), "units": F.count_if(F.col("unit") != "").over(column), "n": F.count("*").over(column)})
    return each.where("bare AND bares = 1 AND units = n - 1 AND n >= 3").select("doc_id", "line", F.col("text").alias("quote"))


def total_mismatch(docs: DataFrame) -> DataFrame:
    """Totals of tables and lists that no admissible sum makes; see runs.totals()."""
    from docaudit.operators import runs

    return runs.totals(docs).select("doc_id", "line", "quote")


def table_product_mismatch(docs: DataFrame) -> DataFrame:
    """Rows of a table with quantity, price and amount columns whose product is not the amount."""
    cells = table_cells(docs)
    role = F.when(F.lower("text").rlike("^(qty|quantity|hours|units)$"), "q").when(F.lower("text").rlike("price|rate|unit cost"), "p").when(F.lower("text").rlike("^(amount|total|line total)$"), "a")
    heads = cells.where("row = 0").select("doc_id", "tbl", "col", role.alias("role")).where("role IS NOT NULL")
    value = F.regexp_replace(F.regexp_extract("text", "(-?[0-9][0-9,]*(?:\\.[0-9]+)?)", 1), ",", "").try_cast("double")
    wide = cells.where("row > 0").withColumn("value", value).join(heads, ["doc_id", "tbl", "col"]).groupBy("doc_id", "tbl", "line").pivot("role", ["q", "p", "a"]).agg(F.first("value"))
    return wide.where(F.col("q").isNotNull() & F.col("p").isNotNull() & F.col("a").isNotNull() & (F.abs(F.col("q") * F.col("p") - F.col("a")) >= 0.01)).select("doc_id", "line", F.col("a").cast("string").alias("quote"))


def broken_link(docs: DataFrame) -> DataFrame:
    """Links without a target, or to a heading the document does not have."""
    own = links(docs).where("NOT image")
    inner = own.where("target LIKE '#%' AND target <> '#'").withColumn("slug", F.lower(F.expr("substring(target, 2)")))
    slugs = headings(docs).select("doc_id", slug(F.col("text")).alias("slug")).distinct()
    missing = inner.join(slugs, ["doc_id", "slug"], "left_anti")
    return own.where("target IN ('', '#')").select("doc_id", "line", F.col("text").alias("quote")).unionByName(missing.select("doc_id", "line", F.col("text").alias("quote")))


def image_alt_text(docs: DataFrame) -> DataFrame:
    return links(docs).where("image AND trim(text) = ''").select("doc_id", "line", F.col("target").alias("quote"))


def image_file_name_alt(docs: DataFrame) -> DataFrame:
    return links(docs).where(F.col("image") & F.col("text").rlike("(?i)^\\S+\\.(png|jpe?g|gif|svg|webp)$")).select("doc_id", "line", F.col("text").alias("quote"))


def vague_link_text(docs: DataFrame, vague: tuple[str, ...] = ("here", "click here", "read more", "this", "link", "more")) -> DataFrame:
    return links(docs).where(~F.col("image") & F.lower(F.trim("text")).isin(*vague)).select("doc_id", "line", F.col("text").alias("quote"))


def link_text_url_mismatch(docs: DataFrame) -> DataFrame:
    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, "^https?://([^/?#\\s]+)", 1)), "^www\\.", "")
    each = links(docs).where("NOT image").withColumns({"a": host("text"), "b": host("target")})
    return each.where("a <> '' AND b <> '' AND a <> b").select("doc_id", "line", F.col("text").alias("quote"))


def footnote_mismatch(docs: DataFrame) -> DataFrame:
    """Marks without a note and notes without a mark."""
    own = lines(docs).where("NOT in_code")
    notes = own.where(F.col("text").rlike("^\\[\\^[^\\]]+\\]:")).select("doc_id", F.col("line").alias("note_line"), F.regexp_extract("text", "^\\[\\^([^\\]]+)\\]", 1).alias("mark"))
    body = own.withColumn("text", F.regexp_replace("text", "^\\[\\^[^\\]]+\\]:", ""))
    marks = body.select("doc_id", "line", F.explode(F.regexp_extract_all("text", F.lit("\\[\\^([^\\]]+)\\]"), F.lit(1))).alias("mark")).groupBy("doc_id", "mark").agg(F.min("line").alias("line"))
    joined = marks.join(notes, ["doc_id", "mark"], "full_outer").where("line IS NULL OR note_line IS NULL")
    return joined.select("doc_id", F.coalesce("line", "note_line").alias("line"), F.col("mark").alias("quote"))


def unclosed_code_fence(docs: DataFrame) -> DataFrame:
    each = lines(docs).where("fence").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line").alias("line"))
    return each.where("n % 2 = 1").select("doc_id", "line", F.lit("```").alias("quote"))


def heading_echo(docs: DataFrame, limit: int = 60) -> DataFrame:
    """Headings whose words make up `limit` per cent or more of the first sentence under them."""
    heads = headings(docs)
    body = lines(docs).where(~F.col("in_code") & (F.trim("text") != "") & ~F.col("text").startswith("#")).select("doc_id", F.col("line").alias("at"), F.col("text").alias("body"))
    first = heads.join(body, "doc_id").where("at > line").groupBy("doc_id", "line", "text").agg(F.min_by("body", "at").alias("body"))
    words = lambda c: F.array_distinct(F.filter(T.bare_words(F.col(c)), lambda x: F.length(x) > 3))
    sentence = F.element_at(T.sentences(F.col("body")), 1)
    each = first.withColumn("body", sentence).withColumns({"a": words("text"), "b": words("body")})
    return each.where((F.size("a") >= 2) & (F.size(F.array_intersect("a", "b")) * 100 >= limit * F.greatest(F.size("b"), F.lit(1)))).select("doc_id", "line", F.col("text").alias("quote"))


def step_reference_missing(docs: DataFrame) -> DataFrame:
    """References to a step past the last numbered item."""
    most = list_items(docs).where("number IS NOT NULL").groupBy("doc_id").agg(F.max("number").alias("most"))
    found = lines(docs).where("NOT in_code").select("doc_id", "line", F.explode(F.regexp_extract_all("text", F.lit("(?i)\\bstep ([0-9]{1,3})\\b"), F.lit(1))).alias("n"))
    return found.join(most, "doc_id").where("CAST(n AS int) > most").select("doc_id", "line", F.col("n").alias("quote"))


def dangling_figure_reference(docs: DataFrame) -> DataFrame:
    """Figures and tables referred to that no caption names."""
    own = lines(docs).where("NOT in_code")
    caption = "(?i)^\\s*\\**(figure|table) ([0-9]+)[.:]"
    captions = own.where(F.col("text").rlike(caption)).select("doc_id", F.lower(F.regexp_extract("text", caption, 1)).alias("kind"), F.regexp_extract("text", caption, 2).alias("number")).distinct()
    found = own.where(~F.col("text").rlike(caption)).select("doc_id", "line", F.explode(F.regexp_extract_all("text", F.lit("\\b((?:Figure|Table) [0-9]+)\\b"), F.lit(1))).alias("raw"))
    each = found.select("doc_id", "line", "raw", F.lower(F.regexp_extract("raw", "^([A-Za-z]+)", 1)).alias("kind"), F.regexp_extract("raw", "([0-9]+)$", 1).alias("number"))
    return each.join(captions, ["doc_id", "kind", "number"], "left_anti").select("doc_id", "line", F.col("raw").alias("quote"))


def dangling_reference(docs: DataFrame) -> DataFrame:
    """References to a numbered section or article that no heading has."""
    numbers = headings(docs).select("doc_id", F.regexp_extract("text", "(?i)^(?:section|article|§)?\\s*([0-9]+(?:\\.[0-9]+)*)", 1).alias("number")).where("number <> ''").distinct()
    some = numbers.select("doc_id").distinct()
    found = lines(docs).where(~F.col("in_code") & ~F.col("text").startswith("#")).select("doc_id", "line", F.explode(F.regexp_extract_all("text", F.lit("\\b(?:[Ss]ection|[Aa]rticle) ([0-9]+(?:\\.[0-9]+)*)"), F.lit(1))).alias("number"))
    return found.join(some, "doc_id", "left_semi").join(numbers, ["doc_id", "number"], "left_anti").select("doc_id", "line", F.col("number").alias("quote"))


def emoji_heading(docs: DataFrame, limit: int = 3) -> DataFrame:
    found = headings(docs).where(F.col("text").rlike("[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"))
    each = found.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return each.where(F.col("n") >= limit).select("doc_id", "line", F.col("text").alias("quote"))


def bold_label_list(docs: DataFrame, limit: int = 5) -> DataFrame:
    found = list_items(docs).where(F.col("text").rlike("^\\*\\*[^*]+\\*\\*\\s*[:—-]|^\\*\\*[^*]+:\\*\\*"))
    each = found.groupBy("doc_id", "list").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return each.where(F.col("n") >= limit).select("doc_id", "line", F.col("n").cast("string").alias("quote"))


def rule_of_three(docs: DataFrame, limit: int = 70, least: int = 4) -> DataFrame:
    sizes = list_items(docs).groupBy("doc_id", "list").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    each = sizes.groupBy("doc_id").agg(F.count("*").alias("lists"), F.count_if(F.col("n") == 3).alias("threes"), F.min("line").alias("line"))
    return each.where((F.col("lists") >= least) & (F.col("threes") * 100 > limit * F.col("lists"))).select("doc_id", "line", F.col("threes").cast("string").alias("quote"))


def preamble_length(docs: DataFrame, limit: int = 2) -> DataFrame:
    first = headings(docs).where("depth > 1").groupBy("doc_id").agg(F.min("line").alias("first"))
    body = lines(docs).where(~F.col("in_code") & (F.trim("text") != "") & ~F.col("text").startswith("#"))
    each = body.join(first, "doc_id").where("line < first").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return each.where(F.col("n") > limit).select("doc_id", "line", F.col("n").cast("string").alias("quote"))


#: Rule names and the functions that find them; each gives doc_id, line and quote.
RULES = {
    f.__name__.replace("_", "-"): f
    for f in (
        heading_level_skip, empty_section, duplicate_heading, title_length, numbering_gap, empty_list_item, announced_count_mismatch, table_row_overflow, empty_table_cell,
        number_without_unit, broken_link, image_alt_text, image_file_name_alt, vague_link_text, link_text_url_mismatch, footnote_mismatch, unclosed_code_fence, heading_echo,
        step_reference_missing, dangling_figure_reference, dangling_reference, emoji_heading, bold_label_list, rule_of_three, preamble_length,
    )
} | {"total-mismatch": total_mismatch, "line-amount-mismatch": table_product_mismatch}


def findings(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """doc_id, rule, line and quote over the named rules."""
    return reduce(DataFrame.unionByName, [RULES[r](docs).select("doc_id", F.lit(r).alias("rule"), "line", "quote") for r in rules])
