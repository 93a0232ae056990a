"""A team's own rules as data: words, patterns, preferred terms, required sections and modal verbs, with positions.

Findings have doc_id, rule, severity, message, start and end (code points, end exclusive), line and col (from 1) and
quote. All rules read a text in its own row; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import regex_safety

COLUMNS = ("doc_id", "rule", "severity", "message", "start", "end", "line", "col", "quote")


@dataclass(frozen=True)
class Custom:
    """A rule that reports every match of a pattern; lang: of documents in that language alone."""

    rule: str
    pattern: str
    message: str = ""
    severity: str = "warning"
    lang: str | None = None

    def __post_init__(self):
        reason = unsafe(self.pattern)
        if reason:
            raise ValueError(f"{self.rule}: {reason}")


def unsafe(pattern: str) -> str | None:
    """Why a pattern is not run: it is too long, does not compile, can match nothing, refers back, or has too many ways to match.

    Classes by Unicode name (\\p{...}), which Python does not know, are read as word characters here.
    """
    if len(pattern) > regex_safety.MOST_CHARACTERS:
        return "is too long"
    pattern = re.sub(r"\\[pP]\{[^}]*\}", r"\\w", pattern)
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        return f"does not compile: {e}"
    if compiled.match("") is not None and compiled.fullmatch("") is not None:
        return "can match the empty text"
    if re.search(r"\\[1-9]|\(\?P=", pattern):
        return "refers back to a group"
    depth, repeats = 0, [False]
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])+\]|\(\?[:=!<a-zA-Z]*|\(|\)[*+{]?|[*+]|\{[0-9]+,[0-9]*\}|[^\\]", pattern, re.S):
        x = m[0]
        if x.startswith("(") and len(x) >= 1 and not x.startswith(")"):
            depth += 1
            repeats.append(False)
        elif x.startswith(")"):
            inner = repeats.pop() if depth else False
            depth = max(0, depth - 1)
            if inner and x[1:]:
                return "repeats what repeats itself"
            repeats[-1] = repeats[-1] or inner or bool(x[1:])
        elif x in "*+" or x.startswith("{") and len(x) > 1:
            repeats[-1] = True
    try:
        return regex_safety.ambiguity(pattern)
    except ValueError as e:
        return str(e)


def words(rule: str, listed: tuple[str, ...], message: str = "", severity: str = "warning", lang: str | None = None) -> Custom:
    """Whole words or phrases, whatever their case; white space between words may be any."""
    parts = "|".join(r"\s+".join(re.escape(w) for w in x.split()) for x in sorted(listed, key=len, reverse=True))
    return Custom(rule, rf"(?i)(?<![A-Za-z0-9_])(?:{parts})(?![A-Za-z0-9_])", message, severity, lang)


def internal_jargon(listed: tuple[str, ...]) -> Custom:
    return words("internal-jargon", listed, "known inside the team alone")


def requirement_modal(allowed: tuple[str, ...] = ("shall",), modals: tuple[str, ...] = ("shall", "must", "should", "will")) -> Custom:
    """Modal verbs of requirements other than the allowed ones."""
    return words("requirement-modal", tuple(m for m in modals if m not in allowed), f"write {' or '.join(allowed)}", lang="en")


def preferred_terms(terms: dict[str, str]) -> tuple[Custom, ...]:
    return tuple(words("preferred-term", (wrong,), f"write {right}") for wrong, right in terms.items())


def _placed(pattern: str) -> Column:
    """start and quote of every match: the pieces between matches say where each begins."""
    regex = F.lit(pattern)
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split("text", regex, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,quote:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["piece"])
        placed = F.struct(begin.cast("int").alias("start"), x["quote"].alias("quote"))
        return F.struct((begin + F.coalesce(F.length(x["quote"]), F.lit(0))).alias("at"), F.when(x["quote"].isNull(), s["out"]).otherwise(F.array_append(s["out"], placed)).alias("out"))

    zipped = F.zip_with(pieces, found, lambda p, q: F.struct(p.alias("piece"), q.alias("quote")))
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def custom_findings(docs: DataFrame, rules: tuple[Custom, ...]) -> DataFrame:
    """Every match of every rule, in the order of the text. Null texts have none; repeated rows are each answered.

    A pattern that Java's matcher does not compile is a ValueError.
    """
    for r in rules:
        try:
            docs.sparkSession._jvm.java.util.regex.Pattern.compile(r.pattern)
        except IllegalArgumentException as e:
            raise ValueError(f"{r.rule}: does not compile: {e}") from None
    frames = []
    for r in rules:
        own = docs.where("text IS NOT NULL" if r.lang is None else F.col("text").isNotNull() & (F.col("lang") == r.lang))
        hits = T.exploded(own.where(F.col("text").rlike(r.pattern)), ["doc_id", "text"], _placed(r.pattern), "m")
        before = F.substring("text", F.lit(1), F.col("m.start"))
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        col = F.length(F.substring_index(before, "\n", -1)) + 1
        end = F.col("m.start") + F.length("m.quote")
        frames.append(hits.select("doc_id", F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.col("m.start").alias("start"), end.alias("end"), line.alias("line"), col.alias("col"), F.col("m.quote").alias("quote")))
    return reduce(DataFrame.unionByName, frames)


def required_sections(docs: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """doc_id, rule and quote (the heading) of every required heading that a document lacks; case does not count.

    A null text is no document; the empty one lacks all.
    """
    there = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6}[ \t]+([^\n]*?)[ \t#]*$"), F.lit(1)), F.lower)
    wanted = F.array(*(F.lit(h) for h in headings))
    read = docs.where("text IS NOT NULL").select("doc_id", there.alias("there"))
    missing = F.filter(wanted, lambda h: ~F.exists("there", lambda t: t == F.lower(h)))
    return T.exploded(read, ["doc_id"], missing, "quote").select("doc_id", F.lit("required-sections").alias("rule"), "quote")


#: Comments that switch rules off: for the rest of the text, or for the line behind them.
_STET = r"<!--[ \t]*stet(-next-line)?(?:[ \t]+([a-z0-9, -]+?))?[ \t]*-->"


def unsuppressed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings (with doc_id, rule and line) that no comment of their document switches off.

    A comment names rules, or none for all; it counts for the lines behind it, `stet-next-line` for the next alone.
    """
    lines = T.exploded(docs.where(F.contains("text", F.lit("stet"))), ["doc_id"], F.split(T.plain(F.col("text")), "\n", -1), "text", "at")
    marks = lines.where(F.col("text").rlike(_STET)).select(F.col("doc_id").alias("_doc"), (F.col("at") + 1).alias("_at"), (F.regexp_extract("text", _STET, 1) != "").alias("_next"), F.regexp_extract("text", _STET, 2).alias("_rules"))
    named = (F.col("_rules") == "") | F.array_contains(F.split("_rules", r"[ ,]+"), F.col("rule"))
    off = F.when(F.col("_next"), F.col("line") == F.col("_at") + 1).otherwise(F.col("line") > F.col("_at"))
    return found.join(marks, (F.col("doc_id") == F.col("_doc")) & named & off, "left_anti")
