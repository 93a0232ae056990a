"""What is not prose, blanked at its place; and matches of many patterns with their places in the raw text.

Masked text has every character of code, HTML, tables, quotes, headings, image and link targets and URLs replaced by a
blank and all line feeds kept, so a place in it is the same place in the raw text. Places count code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T

COLUMNS = ("doc_id", "rule", "severity", "start", "end", "line", "col", "quote")

#: Blocks that start a line, by how they may begin. Loops over lines are possessive, so that a block of any length
#: takes no stack.
FENCE = r" {0,3}(?<f>`{3,}|~{3,})[^\n]*(?:\n(?! {0,3}\k<f>[`~]*[ \t]*$)[^\n]*)*+(?:\n[^\n]*)?"
BLOCKS = (
    r"\A---[ \t]*\n(?:(?!---[ \t]*$)[^\n]*\n)*+---[ \t]*$",
    r"[ \t]{0,12}\|[^\n]*$",
    r" {0,3}>[^\n]*$",
    r" {0,3}#{1,6}(?:[ \t][^\n]*)?$",
    r" {0,3}[-*_][-*_ \t]{2,}$",
    r" {0,3}\[[^\]\n]+\]:[^\n]*$",
    r"[ \t]*:::[^\n]*$",
)
SPAN = r"(?<!`)(?<t>`{1,3})(?!`)[^\n]*?(?<!`)\k<t>(?!`)"
#: Marks inside lines.
MARKS = (
    r"<!--[\s\S]*?-->",
    r"</?[A-Za-z][^<>\n]*>",
    r"!\[[^\]\n]*\]\([^)\n]*\)",
    r"\[(?=[^\]\n]*\]\()",
    r"\]\([^)\n]*\)",
    r"https?://[^\s<>)\]\"']+",
)
#: A look at the next characters spares most places the rest.
CODE = rf"(?m)^(?= {{0,3}}[`~]){FENCE}|(?=`){SPAN}"
MARKUP = r"(?m)^(?=[ \t]{0,12}[-|>#*_\[:])(?:" + "|".join(BLOCKS) + r")|(?=[<!\[\]h])(?:" + "|".join(MARKS) + ")"
UNDERLINED = r"(?m)^[^\n]*\S[^\n]*\n {0,3}={2,}[ \t]*$"
#: Marks of emphasis, whose words are prose.
EMPHASIS = r"(?=[*~_])(?:\*{2,3}|~~|(?<!\w)_{1,3}(?=\S)|(?<=\S)_{1,3}(?!\w)|(?<![\s*])\*(?!\*)|(?<!\*)\*(?![\s*]))"
_OPEN, _CLOSE = "\x01", "\x02"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut in front of each match, with a mark between match and what follows it (the first piece has no match), and how long matches are.

    The pattern is searched once and the marks say how long matches are, but for texts that hold the marks themselves.
    """
    cut = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
    between, matches = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    behind = F.zip_with(matches, F.slice(between, F.lit(2), F.size(between)), lambda q, x: F.concat(q, F.lit(_CLOSE), x))
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(marked, F.struct(F.concat(F.slice(between, F.lit(1), F.lit(1)), behind).alias("pieces"), F.transform(matches, F.length).alias("sizes"))).otherwise(F.struct(cut.alias("pieces"), F.lit(None).cast("array<int>").alias("sizes")))


def blanked(text: Column, pattern: str, hint: str) -> Column:
    """The text with every match replaced by as many blanks; line feeds stay. Texts without the hint are left alone.

    The pattern is searched once: it marks its matches, and what the marks enclose is blanked.
    """

    def piece(x: Column) -> Column:
        at = F.instr(x, _CLOSE)
        return F.when(at == 0, x).otherwise(F.concat(F.regexp_replace(F.substring(x, F.lit(1), at - 1), r"[^\n]", " "), F.substring(x, at + 1, F.length(x))))

    def made(t: Column) -> Column:
        marked = F.split(F.regexp_replace(F.translate(t, _OPEN + _CLOSE, "  "), pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
        return F.when(t.rlike(hint), F.array_join(F.transform(marked, piece), "")).otherwise(t)

    # The text, itself blanked before, would be made again by a transform.
    return T.held(text, made)


def without_code(text: Column) -> Column:
    return blanked(text, CODE, "[`~]")


def prose(text: Column, emphasis: bool = True) -> Column:
    """The text with all that is not prose blanked, and marks of emphasis too if asked for; null stays null."""
    bare = blanked(blanked(without_code(text), UNDERLINED, "=="), MARKUP, r"(?m)[<!\[\]]|://|^[ \t]{0,12}[-|>#*_:]")
    return blanked(bare, EMPHASIS, "[*~_]") if emphasis else bare


@dataclass(frozen=True)
class Search:
    """A pattern whose every match is a finding; lang: in documents of that language alone.

    ascii is the same pattern for texts of ASCII alone, if a faster one is; every match holds one of `needs`, if any,
    one of `words` (lower-case phrases of ASCII) behind no letter or digit, if any, and a letter beyond ASCII if `wide`.
    """

    rule: str
    severity: str
    pattern: str
    lang: str | None = None
    ascii: str | None = None
    needs: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    wide: bool = False


def _heads(searches: tuple[Search, ...], lang: str | None) -> Column:
    """Phrases that the searches of a language wait for and the text holds: of several that begin at one place the shortest.

    All are looked for at once, so that no pattern is searched for in texts that have none of its phrases.
    """
    listed = sorted({w for s in searches if s.lang == lang for w in s.words}, key=lambda w: (len(w), w))
    if not listed:
        return F.lit(None).cast("array<string>")
    begun: dict[str, list[str]] = {}
    for w in listed:
        begun.setdefault(w[0], []).append(r"\s+".join(re.escape(x) for x in w[1:].split(" ")))
    one = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in begun.items())
    found = F.regexp_extract_all("text", F.lit(f"(?i)(?<![A-Za-z0-9_])(?=({one}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))))


def located(docs: DataFrame, searches: tuple[Search, ...], text: Column | None = None) -> DataFrame:
    """doc_id, rule, severity, start, end, line, col (from 1) and quote of every match, all patterns in one scan.

    docs has doc_id, lang and text; `text` is what is searched, prose() by default. Quotes are of the searched text.
    Null and empty texts have no rows; a pattern that matches the empty text finds nothing there; repeated rows are
    answered each. Texts are dealt to a stated number of tasks, where their matches stay; a row is a match, not a line.
    """
    searched = prose(T.plain(F.col("text"))) if text is None else text
    base = docs.where("text IS NOT NULL").select("doc_id", "lang", F.monotonically_increasing_id().alias("row"), "text").repartition(T.shares(docs), "row")
    base = T.exploded(base, ["doc_id", "lang", "row"], F.array(searched), "text")
    waiting = sorted({s.lang or "" for s in searches if s.words})
    all_words = {w for s in searches for w in s.words}
    if waiting:
        spoken = F.array(*(F.when(F.col("lang") == x if x else F.lit(True), _heads(searches, x or None)) for x in waiting))
        base = T.exploded(base, ["doc_id", "lang", "row", "text"], F.array(F.flatten(F.array_compact(spoken))), "heads")

    def hits(k: int, s: Search) -> Column:
        able = F.lit(True) if s.lang is None else F.coalesce(F.col("lang") == s.lang, F.lit(False))
        if s.needs:
            able = able & reduce(Column.__or__, (F.contains("text", F.lit(x)) for x in s.needs))
        if s.wide:
            able = able & (F.octet_length("text") > F.length("text"))
        if s.words:
            # A shorter phrase may stand for one that begins with it.
            able = able & F.arrays_overlap("heads", F.array(*map(F.lit, sorted(x for x in all_words if any(w.startswith(x) for w in s.words)))))

        def by(pattern: str) -> Column:
            return F.when(F.col("text").rlike(pattern), F.struct(F.lit(k).alias("k"), _pieces(F.col("text"), pattern).alias("cut")))

        made = by(s.pattern) if s.ascii in (None, s.pattern) else F.when(F.octet_length("text") == F.length("text"), by(s.ascii)).otherwise(by(s.pattern))
        return F.when(able, made)

    # Behind explode the patterns are not searched again by what uses their matches.
    found = T.exploded(base, ["doc_id", "row"], F.filter(F.array(*(hits(k, s) for k, s in enumerate(searches))), lambda x: x.isNotNull()), "r")
    cut = T.exploded(found.select("doc_id", "row", "r.k", "r.cut.*"), ["doc_id", "row", "k", "sizes"], F.col("pieces"), "piece", "nth")
    piece = F.col("piece")
    n = F.coalesce(F.get("sizes", F.col("nth") - 1), F.instr(piece, _CLOSE) - 1)
    quote = F.when(F.col("nth") > 0, F.substring(piece, F.lit(1), n))
    own = F.when(F.col("nth") > 0, F.concat(quote, F.substring(piece, n + 2, F.length(piece)))).otherwise(piece)
    # How long a piece is, its line feeds, and what stands behind the last.
    feeds = F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit("")))
    sized = cut.select("doc_id", "row", "k", "nth", quote.alias("quote"), F.length(own).alias("size"), feeds.alias("feeds"), F.length(F.substring_index(own, "\n", -1)).alias("tail"))
    before = Window.partitionBy("row", "k").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "line": F.coalesce(F.sum("feeds").over(before), F.lit(0)) + 1})
    last_feed = F.max(F.when(F.col("feeds") > 0, F.col("start") + F.col("size") - F.col("tail"))).over(before)
    lined = placed.withColumn("last_feed", F.coalesce(last_feed, F.lit(0))).where("quote <> ''")
    known = F.array(*(F.struct(F.lit(s.rule).alias("rule"), F.lit(s.severity).alias("severity")) for s in searches))
    col = (F.col("start") - F.col("last_feed") + 1).cast("int").alias("col")
    named = lined.withColumn("s", F.element_at(known, F.col("k") + 1))
    return named.select("doc_id", "s.rule", "s.severity", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("quote")).cast("int").alias("end"), F.col("line").cast("int").alias("line"), col, "quote")


def searches_of(*families, settings=None) -> tuple[Search, ...]:
    """Every pattern and phrase of the rule families as searches; phrases are found as whole words, whatever their case.

    A phrase that counts at one place of a document alone (its opening, its end) is left to phrase_findings().
    """
    from docaudit.operators import custom
    from docaudit.plans.rules import NEEDS, WIDE, Settings, java

    settings, out = settings or Settings(), []
    for r in reduce(lambda a, b: (*a, *b), families, ()):
        if settings.limit(r.rule, r.limits) is None:
            continue
        if hasattr(r, "pattern"):
            needs = NEEDS.get(r.rule, ())
            out.append(Search(r.rule, r.severity, java(r.pattern), r.lang, java(r.pattern, True), () if "japanese" in needs else needs, wide="japanese" in needs or r.rule in WIDE))
        elif getattr(r, "where", "") == "any":
            words = tuple(p.lower() for p in r.phrases) if all(p.isascii() and " ".join(p.split()) == p for p in r.phrases) else ()
            out.append(Search(r.rule, r.severity, custom.words(r.rule, r.phrases).pattern, r.lang, words=words))
    return tuple(out)


def ordered(found: DataFrame, rules: tuple[str, ...] = ()) -> DataFrame:
    """Findings by document, line and column; of one place in the order of `rules`, others behind by name."""
    ordinal = F.coalesce(F.array_position(F.array(*map(F.lit, rules)).cast("array<string>"), F.col("rule")), F.lit(0))
    return found.orderBy("doc_id", "line", "col", F.when(ordinal == 0, len(rules) + 1).otherwise(ordinal), "rule")
