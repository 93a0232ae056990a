"""Runs of list items, table rows and sibling headings: dates and versions in order, and totals with all their sums."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from docaudit.functions import text as T
from docaudit.operators import mentions, ranges, tables, tree

LIST_ITEM = r"^[ \t]{0,12}(?:[-*+]|[0-9]{1,3}[.)])[ \t]"
TABLE_ROW = r"^[ \t]{0,12}\|"
TABLE_RULE = r"^[ \t]{0,12}\|?[ \t]{0,4}:?-{3,}"
INDENTS = range(13)
VERSION = r"^\[?v?([0-9]{1,4})\.([0-9]{1,4})\.([0-9]{1,4})(?:-([0-9A-Za-z.-]+))?\]?(?![\w.])"
MONTH = r"\b[0-9]{4}-(?:0[1-9]|1[0-2])\b(?!-)"


def runs(docs: DataFrame, asked: Column | None = None) -> DataFrame:
    """row, doc_id, run, kind (list or table), tbl (of a table's header), line, start, indent and text.

    Items of one indent are a run up to the next line that is no item or stands less deep; deeper lists between them
    are runs of their own. A table's header and rule are in no run, its rows have the rule's line as tbl. Code is blank.
    Lines for which `asked` is true come too, run or not, and say so in a column of that name; those in no run have no kind.
    """
    each = tree.lines(docs)
    kind = F.when(F.col("text").rlike(TABLE_ROW), "table").when(F.col("text").rlike(LIST_ITEM), "list")
    indent = F.least(F.length(F.regexp_extract("text", "^([ \t]*)", 1)), F.lit(INDENTS[-1]))
    each = each.withColumns({"kind": kind, "indent": indent, "rule": F.col("text").rlike(TABLE_RULE)})
    in_order = Window.partitionBy("row").orderBy("line")
    before = F.lag("kind").over(in_order)
    each = each.withColumns({"breaks": F.col("kind").isNull() | ~before.eqNullSafe(F.col("kind")), "header": F.coalesce(F.lead("rule").over(in_order), F.lit(False)) & (F.col("kind") == "table")})
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    closed = F.array(*(F.last(F.when(F.col("breaks") | (F.col("indent") < d), F.col("line")), True).over(so_far) for d in INDENTS))
    each = each.withColumns({"run": F.coalesce(F.element_at(closed, F.col("indent") + 1), F.lit(0)), "tbl": F.coalesce(F.last(F.when(F.col("rule"), F.col("line")), True).over(so_far), F.lit(0))})
    inside = F.col("kind").isNotNull() & ~F.col("rule") & ~F.col("header")
    if asked is not None:
        each = each.withColumn("asked", asked)
        each = each.where(inside | F.col("asked")).withColumn("kind", F.when(inside, F.col("kind")))
    else:
        each = each.where(inside)
    kept = each
    return kept.select(*(["asked"] if asked is not None else []), "row", "doc_id", "run", "kind", F.when(F.col("tbl") > F.col("run"), F.col("tbl")).otherwise(F.col("run")).alias("tbl"), "line", "start", "indent", "text")


def sibling_headings(docs: DataFrame) -> DataFrame:
    """row, doc_id, run, line, start, indent (their depth) and text of headings of one depth under one less deep heading."""
    each = tree.lines(docs).where(F.col("text").rlike(tree.HEADING)).withColumn("indent", F.length(F.regexp_extract("text", tree.HEADING, 1)))
    so_far = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.array(*(F.last(F.when(F.col("indent") < d, F.col("line")), True).over(so_far) for d in range(1, 7)))
    return each.withColumn("run", F.coalesce(F.element_at(closed, F.col("indent")), F.lit(0))).select("row", "doc_id", "run", "line", "start", "indent", "text")


def _lengths(values: list[str]) -> list[int]:
    """For each value the longest run in order that ends with it, equal ones included, by patience sorting."""
    tails: list[str] = []
    out = []
    for v in values:
        k = bisect_right(tails, v)
        tails[k : k + 1] = [v]
        out.append(k + 1)
    return out


def culprits(values: list[str], days: list[float] | None = None, versions: list[str | None] | None = None) -> list[int]:
    """Places of the values that break the order most of them follow, up or down.

    Each step against the majority names the value whose removal leaves the longer run in order; if both do alike, the
    one that disagrees with more others where all versions are in order, else the one farther from its outer neighbour
    where the two are swapped, else the later. Silent if as many steps go up as down, or no more than half of the
    values are in order.
    """
    n = len(values)
    signs = [(b > a) - (b < a) for a, b in zip(values, values[1:])]
    direction = (signs.count(1) > signs.count(-1)) - (signs.count(1) < signs.count(-1))
    if not direction:
        return []
    ending = _lengths(values) if direction > 0 else _lengths_down(values)
    starting = _lengths_down(values[::-1])[::-1] if direction > 0 else _lengths(values[::-1])[::-1]
    longest = max(ending)
    if 2 * longest <= n:
        return []
    level: dict[int, int] = {}
    for a, b in zip(ending, starting):
        if a + b - 1 == longest:
            level[a] = level.get(a, 0) + 1
    #: Whether every longest run holds the value: it is the only one at its place.
    needed = [a + b - 1 == longest and level[a] == 1 for a, b in zip(ending, starting)]
    along = _versions_along(versions, direction)
    found = []
    for k, sign in enumerate(signs):
        if sign != -direction:
            continue
        before, after = k, k + 1
        if needed[before] != needed[after]:
            found.append(after if needed[before] else before)
            continue
        worse = _by_disagreement(values, before, after, direction) if along else None
        if worse is None and days is not None:
            worse = _by_gap(values, days, before, after, direction)
        found.append(after if worse is None else worse)
    return list(dict.fromkeys(found))


def _lengths_down(values: list[str]) -> list[int]:
    order = {v: k for k, v in enumerate(sorted(set(values), reverse=True))}
    return _lengths([order[v] for v in values])


def _versions_along(versions: list[str | None] | None, direction: int) -> bool:
    if not versions or any(v is None for v in versions):
        return False
    return all((b > a) - (b < a) != -direction for a, b in zip(versions, versions[1:]))


def _by_disagreement(values: list[str], before: int, after: int, direction: int) -> int | None:
    def against(k: int) -> int:
        signs = [(values[k] > x) - (values[k] < x) for x in values[:k]] + [(x > values[k]) - (x < values[k]) for x in values[k + 1 :]]
        return signs.count(-direction)

    a, b = against(before), against(after)
    return None if a == b else before if a > b else after


def _by_gap(values: list[str], days: list[float], before: int, after: int, direction: int) -> int | None:
    if before == 0 or after + 1 == len(values):
        return None
    outer = (values[before - 1], values[after + 1])
    fits = lambda a, b: (b > a) - (b < a) != -direction
    if not all(fits(outer[0], values[k]) and fits(values[k], outer[1]) for k in (before, after)):
        return None
    a, b = abs(days[before] - days[before - 1]), abs(days[after + 1] - days[after])
    return None if a == b else before if a > b else after


@F.pandas_udf(ArrayType(IntegerType()))
def _culprits(values: pd.Series, days: pd.Series, versions: pd.Series) -> pd.Series:
    """culprits() of each run; a run is a list, a table or the headings of one document."""
    return pd.Series([culprits(list(v), None if d is None else list(d), None if x is None else list(x)) for v, d, x in zip(values, days, versions)])


def version_key(text: Column) -> Column:
    """A text that sorts as versions do: parts as numbers, a release behind its pre-releases; null if none leads the text."""
    part = lambda k: F.lpad(F.regexp_extract(text, VERSION, k), 5, "0")
    pre = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, VERSION, 4), "([0-9]+)", "0000$1"), "0*([0-9]{5})", "$1")
    return F.when(text.rlike(VERSION), F.concat(part(1), part(2), part(3), F.when(pre == "", "~").otherwise(pre)))


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t]*(?:#{1,6}|[-*+]|[0-9]{1,3}[.)]|\|)?[ \t]*", "")


def _dated(each: DataFrame) -> DataFrame:
    """Lines with just one date: value (ISO), day (a number) and quote; others have null."""
    day = "|".join((mentions._ISO, mentions._LONG, mentions._BRITISH))
    found = F.regexp_extract_all("text", F.lit(f"({day}|{MONTH})"), F.lit(1))
    # Behind explode the line is not searched again by each column that is made of its date.
    quote = F.when(F.col("text").rlike(f"{day}|{MONTH}"), F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    one = T.exploded(each, each.columns, F.array(F.struct(quote.alias("quote"))), "d").select(*each.columns, "d.quote")
    one = T.exploded(one, one.columns, F.array(F.struct(mentions.date_of(F.col("quote")).alias("date"))), "d").select(*one.columns, "d.date")
    date = F.col("date")
    monthly = F.col("quote").rlike("^[0-9]{4}-[0-9]{2}$")
    value = F.when(monthly, F.col("quote")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    number = F.when(monthly, F.substring("quote", 1, 4).try_cast("int") * 12 + F.substring("quote", 6, 2).try_cast("int")).otherwise(F.unix_date(date))
    return one.withColumns({"value": value, "day": number.cast("double"), "version": version_key(_unmarked(F.col("text")))}).drop("date")


def _out_of_order(points: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Of points (key, line, start, value, day, version, quote, text) those out of place in their run, and the value before (after the first)."""
    point = F.struct("line", "start", "value", "day", "version", "quote", "text")
    grouped = points.groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("points"))
    judged = grouped.where((F.size("points") >= least) & (F.size(F.array_distinct(F.transform("points", lambda p: F.length(p["value"])))) == 1))
    bad = judged.withColumn("at", F.explode(_culprits(F.col("points.value"), F.col("points.day"), F.col("points.version"))))
    own = F.element_at("points", F.col("at") + 1)
    beside = F.when(F.col("at") == 0, F.element_at("points", 2)["value"]).otherwise(F.element_at("points", F.greatest(F.col("at"), F.lit(1)))["value"])
    begin = own["start"] + F.instr(own["text"], own["quote"]) - 1
    return bad.select("doc_id", own["line"].alias("line"), begin.cast("int").alias("start"), (begin + F.length(own["quote"])).cast("int").alias("end"), own["quote"].alias("quote"), beside.alias("beside"))


def _stretches(each: DataFrame, there: Column) -> DataFrame:
    """Headings that have a value, numbered by the stretch between those that have none."""
    in_run = Window.partitionBy("row", "run", "indent").orderBy("line")
    return each.withColumn("stretch", F.count_if(~there).over(in_run)).where(there)


def date_order(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, end, quote and beside of dates out of order in a list, a table or headings side by side.

    A line counts by its only date; days and months are not compared with each other. Null and empty texts and texts
    without a run have none; equal dates are in order; repeated rows are answered each. docs is a stored table.
    """
    listed = _dated(runs(docs)).where("value IS NOT NULL")
    own = _out_of_order(listed, ["doc_id", "row", "run", "kind", "tbl", "indent"])
    headed = _stretches(_dated(sibling_headings(docs)), F.col("value").isNotNull())
    return own.unionByName(_out_of_order(headed, ["doc_id", "row", "run", "indent", "stretch"]))


def version_order(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, end, quote and beside (a sorting key) of versions out of order in lists, tables or headings side by side."""

    def versioned(each: DataFrame) -> DataFrame:
        words = _unmarked(F.col("text"))
        key = version_key(words)
        return each.withColumns({"value": key, "day": F.lit(None).cast("double"), "version": F.lit(None).cast("string"), "quote": F.when(key.isNotNull(), F.regexp_extract(words, VERSION, 0))})

    point = ["doc_id", "row", "run", "indent", "line", "start", "value", "day", "version", "quote", "text"]
    listed = versioned(runs(docs)).where("value IS NOT NULL").select(*point, "tbl", F.lit(0).alias("stretch"))
    headed = _stretches(versioned(sibling_headings(docs)), F.col("value").isNotNull()).select(*point, F.lit(-1).alias("tbl"), F.col("stretch").cast("int").alias("stretch"))
    both = listed.unionByName(headed)
    sized = both.withColumn("day", F.lit(0.0))
    grouped = sized.groupBy("doc_id", "row", "run", "indent", "tbl", "stretch").agg(F.array_sort(F.collect_list(F.struct("line", "start", "value", "day", "version", "quote", "text"))).alias("points"))
    bad = grouped.where(F.size("points") >= 3).withColumn("at", F.explode(_culprits(F.col("points.value"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<string>"))))
    own = F.element_at("points", F.col("at") + 1)
    beside = F.when(F.col("at") == 0, F.element_at("points", 2)["quote"]).otherwise(F.element_at("points", F.greatest(F.col("at"), F.lit(1)))["quote"])
    begin = own["start"] + F.instr(own["text"], own["quote"]) - 1
    return bad.select("doc_id", own["line"].alias("line"), begin.cast("int").alias("start"), (begin + F.length(own["quote"])).cast("int").alias("end"), own["quote"].alias("quote"), beside.alias("beside"))


_DATE = "|".join((mentions._ISO, mentions._LONG, mentions._BRITISH))
#: A line that states the period of what a document lists.
PERIOD = rf"(?i)^[-*#|\s]*(?:\w+ )?(?:period|term|dates covered)[* ]*[:|]\s*({_DATE})\s*(?:to|until|through|–|-)\s*({_DATE})"


def dates_outside_period(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, end and quote of dates of list items and table rows that none of their document's periods holds.

    A line counts by its only date. Documents that state no period are not judged; a period that ends before it starts
    holds nothing. Periods and dates meet in the order of days, not each with each. docs is a stored table.
    """
    bound = lambda k: F.unix_date(mentions.date_of(F.regexp_extract("text", PERIOD, k)))
    keep = ["doc_id", "row", "line", "start", "text"]
    # A line of a period is never one of a date alone: it has two.
    each = _dated(runs(docs, F.col("text").rlike(PERIOD))).withColumn("at", F.when((F.length("value") == 10) & F.col("kind").isNotNull(), F.col("day").cast("int")))
    each = each.withColumns({"first": F.when(F.col("asked"), bound(1)), "last": F.when(F.col("asked"), bound(2))})
    each = T.exploded(each, [*keep, "quote"], F.array(F.struct("at", "first", "last")), "x").select(*keep, "quote", "x.*").where("at IS NOT NULL OR (first IS NOT NULL AND last IS NOT NULL)")
    judged = each.withColumn("stated", F.max(F.col("first").isNotNull()).over(Window.partitionBy("row")))
    out = ranges.unheld(judged.where("stated"), ["row"], "at", "first", "last")
    begin = F.col("start") + F.instr("text", F.col("quote")) - 1
    return out.select("doc_id", "line", begin.cast("int").alias("start"), (begin + F.length("quote")).cast("int").alias("end"), "quote")


#: Labels of totals (fixed words), those of a span of time, and those that close a table without naming what they sum.
TOTALS = ("total", "subtotal", "sub-total", "grand total", "sum", "amount due", "balance due", "合計", "小計", "総計", "計")
SPAN_TOTALS = ("annual total", "yearly total", "total for the year", "total per year", "年間合計")
CLOSING = ("net total", "total deductions", "net amount", "net pay", "差引合計", "控除合計")
_BEHIND = r"[*_]*\s*(?:\([^()|]*\)\s*|（[^（）|]*）\s*)*(?:$|[:：|]|[-−▲△$€£¥￥\p{N}])"
_AMOUNT = r"([-−▲△]\s?)?([$€£¥￥])?\s?([-−▲△])?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(%|円|[A-Za-z]{1,8}\b)?"


def _labelled(text: Column, words: tuple[str, ...]) -> Column:
    lead = F.lower(F.regexp_replace(F.regexp_replace(text, r"^[ \t]*(?:[-*+]|[0-9]{1,3}[.)])?[ \t]*(?:\|[ \t]*)*", ""), r"^[*_]+\s*", ""))
    return lead.rlike("^(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")" + _BEHIND)


def _amounts(docs: DataFrame) -> DataFrame:
    """row, doc_id, run, kind, tbl, line, col, at, quote, cents, unit and unsure of what each column of a run has on a line.

    A list is one column. unsure: its sign or number is not plain (brackets, several amounts). Cells without an amount
    have null cents; they are unsure in columns of numbers without a unit.
    """
    each = runs(docs)
    inner = F.regexp_replace(F.regexp_replace("text", r"^\s*\|", ""), r"\|\s*$", "")
    cells = F.when(F.col("kind") == "table", F.split(inner, r"(?<!\\)\|", -1)).otherwise(F.array(F.regexp_replace("text", LIST_ITEM, "")))
    wide = each.select("row", "doc_id", "run", "kind", "tbl", "indent", "line", "start", F.col("text").alias("whole"), F.posexplode(cells).alias("col", "cell")).where("kind = 'list' OR col > 0")
    plain = F.trim(F.regexp_replace("cell", r"[*_]+", ""))
    found = F.regexp_extract_all(plain, F.lit(_AMOUNT), F.lit(0))
    full = plain.rlike(f"^{_AMOUNT}$")
    one = wide.withColumns({"n": F.size(found), "raw": F.get(found, F.lit(0)), "full": full, "bracketed": plain.rlike(r"[(（]\s?[$€£¥￥]?\s?[0-9]")})
    part = lambda k: F.regexp_extract("raw", _AMOUNT, k)
    value = F.regexp_replace(part(4), ",", "").try_cast("decimal(24,6)")
    negative = (part(1) != "") | (part(3) != "")
    known = (F.col("n") == 1) & (F.col("full") | (F.col("kind") == "list"))
    cents = F.when(known, F.round(value * 100).cast("bigint") * F.when(negative, -1).otherwise(1))
    unit = F.when(known, F.concat(part(2), part(5)))
    made = one.select("row", "doc_id", "run", "kind", "tbl", "indent", "line", "col", "start", "whole", F.trim("raw").alias("quote"), cents.alias("cents"), unit.alias("unit"), ((F.col("n") > 1) | F.col("bracketed")).alias("unsure"))
    column = Window.partitionBy("row", "run", "indent", "tbl", "col")
    units = F.size(F.collect_set("unit").over(column))
    bare = F.max("unit").over(column) == ""
    blank = F.col("cents").isNull()
    return made.withColumns({"bare": bare, "mixed": units > 1}).withColumn("unsure", F.col("unsure") | F.col("mixed") | (F.col("bare") & blank & (F.col("kind") == "table")))


def totals(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, end, quote, written and expected (cents) of totals in lists and tables that no admissible sum makes.

    A total may be the sum of all items, of those behind the last total, or of that total and them; the last row of a
    table that names what it nets may also be the sum of its last items, or the rest less those; a total for a year may
    be four, twelve or fifty-two times a sum. Columns with several units, several amounts in a cell or amounts in
    brackets are not judged, nor are bare numbers whose total is not above each item. See tables.inadmissible_totals().
    """
    each = _amounts(docs)
    label = _labelled(F.col("whole"), (*TOTALS, *SPAN_TOTALS))
    column = ["row", "run", "indent", "tbl", "col"]
    whole = Window.partitionBy(*column)
    ends = (F.col("line") == F.max("line").over(whole)) & (F.col("kind") == "table") & _labelled(F.col("whole"), CLOSING) & ~F.max(label).over(whole)
    rows = each.withColumns({"span": _labelled(F.col("whole"), SPAN_TOTALS), "closing": ends}).withColumn("label", label | F.col("closing"))
    found = tables.inadmissible_totals(rows, column, "line", "label", "cents", unsure="unsure", bare="bare", closing="closing", span="span", keep=["doc_id", "start", "whole", "quote"])
    begin = F.col("start") + F.instr("whole", F.col("quote")) - 1
    return found.select("doc_id", "line", begin.cast("int").alias("start"), (begin + F.length("quote")).cast("int").alias("end"), "quote", "written", "expected")
