"""Functions in fenced code against the parameter table under them: names that only one of the two has."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docaudit.functions import text as T
from docaudit.operators import tree

#: First header cells of tables of parameters.
HEADERS = ("parameter", "parameters", "param", "argument", "arguments", "arg", "引数", "パラメータ", "パラメーター")
#: The instance or class that a method takes first, which tables leave out.
RECEIVERS = ("self", "cls", "this")
FENCE = r"^ {0,3}(?:`{3,}|~{3,})"
TABLE_ROW, DELIMITER = r"^[ \t]{0,3}\|", r"^[ \t]{0,3}\|?[ \t]*:?-{3,}"
_NAME = r"[A-Za-z_$][\w$]*"
_LEAD = r"^[ \t]*(?:(?:export|declare|async)[ \t]+)*"
#: Up to the opening bracket of the parameters, with the function's name; what must stand behind the closing one.
DECLARATIONS = (
    (rf"{_LEAD}(?:function\*?|def|fn|func)[ \t]+(?:\([^()]*\)[ \t]*)?({_NAME})[ \t]*(?:<[^<>()]*>)?[ \t]*\(", ""),
    (rf"{_LEAD}(?:const|let|var)[ \t]+({_NAME})[^=]*=[ \t]*(?:async[ \t]*)?\(", r"^[ \t]*(?::[^=]*)?=>"),
    (rf"{_LEAD}({_NAME})[ \t]*(?:<[^<>()]*>)?[ \t]*\(", r"^[ \t]*(?::|->)"),
)
_PARAMETER = rf"^\s*(?:\.\.\.|\*{{1,2}}|&(?:mut[ \t]+)?|mut[ \t]+)?({_NAME})"
_COMMA, _END = "\x01", "\x02"
_SIGNS = re.compile(r"[()\[\]{}<>,]")


def mark(behind: str) -> str:
    """What follows an opening bracket, commas at its own depth as marks, its closing bracket as another; brackets nest."""
    depth, at, out = 0, 0, []
    for m in _SIGNS.finditer(behind):
        c, k = m[0], m.start()
        if c == ",":
            if not depth:
                out += behind[at:k], _COMMA
                at = k + 1
        elif c in "([{<":
            depth += 1
        elif c == ")" and not depth:
            return "".join((*out, behind[at:k], _END, behind[k + 1 :]))
        elif c != ">" or behind[:k][-1:] not in ("=", "-"):
            depth -= 1
    return "".join((*out, behind[at:]))


@F.pandas_udf(StringType())
def _marked(behind: pd.Series) -> pd.Series:
    """mark() of each text, null for null."""
    return behind.map(mark, na_action="ignore")


def signature(line: Column) -> Column:
    """The function (fn) that a line of code declares and its parameters' names, without receivers; null for other lines.

    The brackets close on the line; a parameter without a plain name (a pattern) makes it no signature.
    """
    made = []
    for pattern, behind in DECLARATIONS:
        # Lines that declare nothing go to Python as nulls.
        marked = _marked(F.when(line.rlike(pattern), F.translate(F.regexp_replace(line, pattern, ""), _COMMA + _END, "  ")))
        parts = F.filter(F.split(F.substring_index(marked, _END, 1), _COMMA), lambda p: F.trim(p) != "")
        names = F.transform(parts, lambda p: F.regexp_extract(p, _PARAMETER, 1))
        fits = F.contains(marked, F.lit(_END)) & F.substring_index(marked, _END, -1).rlike(behind or "^") & ~F.array_contains(names, "")
        own = F.filter(names, lambda x: ~x.isin(*RECEIVERS))
        made.append(F.when(fits, F.struct(F.regexp_extract(line, pattern, 1).alias("fn"), own.alias("names"))))
    return F.coalesce(*made)


def _unwrapped(cell: Column) -> Column:
    return F.regexp_replace(F.trim(cell), r"^[`*_]+|[`*_]+$", "")


def parameter_mismatches(docs: DataFrame) -> DataFrame:
    """doc_id, line (of the table's header), fn, name and side: parameters that the table or the signature alone names.

    A block of code with one signature is compared with the first table behind it, up to the next heading or block, if
    its first header is one of HEADERS. Null and empty texts have none; repeated rows are each answered.
    """
    # Texts without a fence have no code. Texts are dealt, not their lines: what is cut from a text stays where its row is.
    able = F.contains("text", F.lit("|")) & (F.contains("text", F.lit("```")) | F.contains("text", F.lit("~~~")))
    plain = docs.where(able).select("doc_id", F.monotonically_increasing_id().alias("row"), T.plain(F.col("text")).alias("text")).repartition(T.shares(docs), "row")
    each = T.exploded(plain, ["row", "doc_id"], F.split("text", "\n", -1), "text", "line").withColumn("line", F.col("line") + 1)
    order = Window.partitionBy("row").orderBy("line")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"fence": F.col("text").rlike(FENCE), "delimiter": F.col("text").rlike(DELIMITER)})
    each = each.withColumns({"fences": F.count_if("fence").over(so_far), "ruled": F.coalesce(F.lead("delimiter").over(order), F.lit(False))})
    code = (F.col("fences") % 2 == 1) & ~F.col("fence")
    outside = (F.col("fences") % 2 == 0) & ~F.col("fence")
    row_of = outside & F.col("text").rlike(TABLE_ROW)
    each = each.withColumns({"row_of": row_of, "header": row_of & F.col("ruled") & ~F.col("delimiter"), "sig": signature(F.when(code & F.contains("text", F.lit("(")), F.col("text")))})
    # The line that closes a block sees what its block declares: what came since the line that opened it.
    opens, closes = F.col("fence") & (F.col("fences") % 2 == 1), F.col("fence") & (F.col("fences") % 2 == 0)
    each = each.withColumns({"sigs": F.count("sig").over(so_far), "own": F.last("sig", True).over(before)})
    each = each.withColumn("n", F.col("sigs") - F.last(F.when(opens, F.col("sigs")), True).over(so_far))
    none = F.struct(F.lit(None).cast("struct<fn:string,names:array<string>>").alias("sig"))
    event = F.when(closes & (F.col("n") == 1), F.struct(F.col("own").alias("sig"))).when(F.col("fence") | F.col("header") | (outside & F.col("text").rlike(r"^ {0,3}#{1,6}[ \t]")), none)
    each = each.withColumn("event", event)
    each = each.withColumns({"pending": F.last("event", True).over(before), "broken": F.coalesce(F.last(F.when(~F.col("row_of"), F.col("line")), True).over(so_far), F.lit(0)), "head": F.last(F.when(F.col("header"), F.col("line")), True).over(so_far)})
    first = _unwrapped(F.get(F.split(F.regexp_replace("text", r"^\s*\|", ""), r"(?<!\\)\|", -1), F.lit(0)))
    inside = each.where(F.col("row_of") & (F.col("head") > F.col("broken"))).withColumn("first", first)
    # A table meets its signature in one row; those that none waits for are not answered.
    waits = F.when(F.col("header") & F.lower("first").isin(*HEADERS), F.col("pending.sig"))
    named = F.when(~F.col("header") & ~F.col("delimiter"), F.nullif(F.regexp_extract("first", _PARAMETER, 1), F.lit("")))
    tables = inside.groupBy("row", "doc_id", "head").agg(F.first(waits, True).alias("sig"), F.collect_set(named).alias("names")).where("sig IS NOT NULL")
    side = lambda a, b, name: F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("name"), F.lit(name).alias("side")))
    apart = F.concat(side("sig.names", "names", "signature"), side("names", "sig.names", "table"))
    return T.exploded(tables, ["doc_id", "head", "sig"], apart, "x").select("doc_id", F.col("head").alias("line"), "sig.fn", "x.name", "x.side")
