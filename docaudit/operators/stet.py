"""Comments that let findings stand: what each covers, and which findings it takes away.

`<!-- stet: rule-a, rule-b — why -->` covers the block right below it (or the one it stands in), `stet-section` all up
to the next heading, `stet-file` the whole document. A comment without a dash and a reason works, but is listed.
Scopes are intervals of lines, and findings meet them by a join of points and intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import ranges

#: Kind, then what stands up to the end of the comment.
COMMENT = r"<!--\s*(stet|stet-section|stet-file)\s*:([^>]*?)-->"
#: Between the rules and the reason.
DASH = "—"
#: Names of rules, and of a plugin's after its name.
RULE = r"^[a-z][a-z0-9-]*(/[a-z][a-z0-9-]*)?$"
#: Behind the last line of any document.
END = 1 << 30


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, line and text of documents that hold such a comment, code left out; a comment over several lines is on its first."""
    own = docs.where(F.contains("text", F.lit("stet"))).select("doc_id", T.plain(F.col("text")).alias("text"))
    marked = own.where(F.col("text").rlike(COMMENT)).withColumn("row", F.monotonically_increasing_id()).repartition(T.shares(docs), "row")
    cut = T.exploded(marked, ["row", "doc_id", F.regexp_extract_all("text", F.lit(COMMENT), F.lit(0)).alias("comments")], F.split("text", "\n", -1), "text", "line")
    return cut.withColumn("line", F.col("line") + 1)


def scopes(docs: DataFrame) -> DataFrame:
    """doc_id, rule, scope, line (of the comment), first, last (lines it covers) and reason of every rule that a comment names.

    Null and empty texts have none; a comment inside a fenced block counts as any other; names that no rule could have
    are left out.
    """
    each = _lines(docs)
    in_order = Window.partitionBy("row").orderBy("line")
    ahead = in_order.rowsBetween(1, Window.unboundedFollowing)
    blank = F.trim("text") == ""
    opens = F.col("text").rlike(r"<!--\s*stet(-section|-file)?\s*:")
    alone = F.regexp_replace("text", r"<!--[^>]*(-->|$)", "").rlike(r"^\s*$") & opens
    heading = F.col("text").rlike(r"^ {0,3}#{1,6}([ \t]|$)")
    kind = F.when(heading, "heading").when(F.col("text").rlike(r"^\s*\|"), "table").when(F.col("text").rlike(r"^\s*([-*+]|[0-9]{1,3}[.)])\s"), "list").otherwise("text")
    # A comment may end on a later line; what is behind it starts the block.
    open_ = opens & ~F.contains("text", F.lit("-->"))
    closes = ~opens & F.contains("text", F.lit("-->"))
    inside = F.coalesce(F.last(F.when(open_, True).when(F.contains("text", F.lit("-->")), False), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    seen = each.withColumns({"blank": blank, "opens": opens, "alone": alone, "heading": heading, "kind": kind, "within": inside, "closes": closes})
    solid = ~F.col("blank") & ~F.col("within") & ~(F.col("alone"))
    before = F.lag("kind").over(in_order)
    # A block starts behind a blank line, at and behind a heading, and where a list or a table starts or ends; a list goes on over blank lines.
    was_blank = F.coalesce(F.lag("blank").over(in_order), F.lit(True)) | F.coalesce(F.lag("alone").over(in_order), F.lit(False)) | F.coalesce(F.lag("within").over(in_order), F.lit(False))
    last_kind = F.last(F.when(solid, F.col("kind")), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.col("text").rlike(r"^\s+\S") & (last_kind == "list")
    starts = solid & ~goes_on & F.when(F.col("kind") == "list", last_kind.isNull() | (last_kind != "list")).otherwise(was_blank | F.col("heading") | (before == "heading") | (F.col("kind") != before))
    blocks = seen.withColumns({"starts": starts, "solid": solid})
    numbered = blocks.withColumn("block", F.count_if("starts").over(in_order))
    ends = numbered.withColumn("block_end", F.max(F.when(F.col("solid"), F.col("line"))).over(Window.partitionBy("row", "block")))
    placed = ends.withColumns({
        "below": F.first(F.when(F.col("starts") | F.col("solid"), F.col("block_end")), True).over(ahead),
        "section_end": F.first(F.when(F.col("heading"), F.col("line")), True).over(ahead),
    }).where("opens")
    # The comments of a line in their order: those of the lines before it come first in the document's list.
    n = F.regexp_count("text", F.lit(r"<!--\s*stet(-section|-file)?\s*:"))
    counted = placed.withColumns({"n": n, "skipped": (F.sum(n).over(in_order) - n).cast("int")})
    own = counted.withColumn("comment", F.explode(F.slice("comments", F.col("skipped") + 1, F.col("n"))))
    body = F.regexp_extract("comment", COMMENT, 2)
    at = F.instr(body, DASH)
    head = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)
    reason = F.when(at > 0, F.regexp_replace(F.substring(body, at + 1, F.length(body)), r"^\s+|\s+$", ""))
    scope = F.element_at(F.create_map(*map(F.lit, ("stet", "next", "stet-section", "section", "stet-file", "file"))), F.regexp_extract("comment", COMMENT, 1))
    last_line = F.col("line") + F.length("comment") - F.length(F.replace("comment", F.lit("\n"), F.lit("")))
    last = F.when(scope == "file", END).when(scope == "section", F.coalesce("section_end", F.lit(END))).when(F.col("alone"), F.coalesce("below", last_line)).otherwise(F.col("block_end"))
    rules = F.filter(F.transform(F.split(head, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(RULE))
    named = own.select("doc_id", F.explode(rules).alias("rule"), scope.alias("scope"), "line", F.when(scope == "file", 0).otherwise(F.col("line")).alias("first"), last.cast("int").alias("last"), F.when(reason != "", reason).alias("reason"))
    return named


def kept(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings (with doc_id, rule and line) that no comment covers; those without a line meet stet-file alone."""
    own = scopes(docs).select("doc_id", "rule", F.col("first").alias("_first"), F.col("last").alias("_last"))
    placed = found.withColumns({"_line": F.coalesce(F.col("line"), F.lit(0)), "_first": F.lit(None).cast("int"), "_last": F.lit(None).cast("int")})
    both = placed.unionByName(own, allowMissingColumns=True)
    return ranges.unheld(both, ["doc_id", "rule"], "_line", "_first", "_last").select(*found.columns)


def suppressed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings that a comment covers, each with the line and reason of the first such comment."""
    own = scopes(docs).select("doc_id", "rule", "first", "last", F.col("line").alias("by_line"), "reason")
    placed = found.withColumns({"_line": F.coalesce(F.col("line"), F.lit(0)), "_nth": F.monotonically_increasing_id()})
    met = ranges.within(placed, own, ["doc_id", "rule"], "_line", "first", "last")
    first = met.groupBy("_nth", *found.columns).agg(F.min(F.struct("by_line", "reason")).alias("by"))
    return first.select(*found.columns, "by.by_line", "by.reason")


def without_reason(docs: DataFrame) -> DataFrame:
    """doc_id and line of comments that say no reason."""
    return scopes(docs).where("reason IS NULL").select("doc_id", "line").distinct()
