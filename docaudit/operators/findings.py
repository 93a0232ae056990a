"""Rules over documents: every family in one pass, to one findings table.

Findings have doc_id, rule, severity, n (what was counted) and quote (the first match). Limits come from Settings; a
rule that is off, or whose language a document is not in, gives a row of not_run instead of silence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.plans import model
from docaudit.plans.rules import FORMS, NEEDS, PATTERNS, PHRASES, Forms, Pattern, Phrases, Settings, java

#: A density over fewer words says nothing.
LEAST_WORDS = 200
COLUMNS = ("doc_id", "rule", "severity", "n", "quote")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _in_language(lang: str | None) -> Column:
    return F.lit(True) if lang is None else F.col("lang") == lang


def _by_letters(made, pattern: str) -> Column:
    """made(regex) over texts of ASCII alone, where a plain word boundary is the same and much faster, and over others."""
    if java(pattern, True) == java(pattern):
        return made(F.lit(java(pattern)))
    return F.when(F.octet_length("text") == F.length("text"), made(F.lit(java(pattern, True)))).otherwise(made(F.lit(java(pattern))))


def _searched(docs: DataFrame, *columns: str) -> DataFrame:
    """The texts there are, with `japanese`: whether they have a letter of one of its scripts."""
    japanese = (F.octet_length("text") > F.length("text")) & F.col("text").rlike(java(r"[\p{Han}\p{Hiragana}\p{Katakana}]"))
    return docs.where("text IS NOT NULL").select("doc_id", "lang", "text", *columns, japanese.alias("japanese"))


def _count(pattern: str, key: str, lang: str | None) -> Column:
    """Matches of the pattern, none where the language differs or the text lacks what every match holds."""
    needs = NEEDS.get(key, ())
    there = [F.col("japanese") if x == "japanese" else F.contains("text", F.lit(x)) for x in needs]
    able = _in_language(lang) & (reduce(Column.__or__, there) if there else F.lit(True))
    return F.when(able, _by_letters(lambda x: F.regexp_count("text", x), pattern)).otherwise(0)


def _quote(pattern: str) -> Column:
    return _by_letters(lambda x: F.regexp_substr("text", x), pattern)


def _row(rule, n: Column, quote: Column) -> Column:
    return F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.severity).alias("severity"), n.cast("bigint").alias("n"), quote.alias("quote"))


def _found(counted: DataFrame, rows: list[Column]) -> DataFrame:
    return T.exploded(counted, ["doc_id"], F.filter(F.array(*rows), lambda x: x.isNotNull()), "f").select("doc_id", "f.*")


def pattern_findings(docs: DataFrame, rules: tuple[Pattern, ...] = PATTERNS, settings: Settings = Settings()) -> DataFrame:
    """Counts of all patterns in one scan; a document's rows are those whose bound is met.

    Densities are matches in 1000 words, rounded, and need LEAST_WORDS words at least; a null text has no findings.
    """
    live = [(k, r, limit) for k, r in enumerate(rules) if (limit := settings.limit(r.rule, r.limits)) is not None]
    sized = _searched(docs).withColumn("n_words", F.size(T.words(F.col("text"))))
    # Each pattern is counted once; what uses a count reads it as a column.
    counted = sized.select("doc_id", "text", "n_words", *(_count(r.pattern, r.rule, r.lang).alias(f"n{k}") for k, r, _ in live))
    rows = []
    for k, r, limit in live:
        n = F.col(f"n{k}")
        dense = (F.col("n_words") >= LEAST_WORDS) & (F.round(n * 1000.0 / F.greatest("n_words", F.lit(1))) > limit)
        rows.append(F.when(dense if r.kind == "density" else n >= limit, _row(r, n, _quote(r.pattern))))
    return _found(counted, rows)


def _bounds(docs: DataFrame) -> DataFrame:
    """doc_id, last (the last paragraph with a sentence) and first (para and sent of the first four sentences): numbers alone are exchanged."""
    cut = T.exploded(docs, ["doc_id"], F.array(T.paragraphs(F.col("text"))), "paras")
    # What is left of a paragraph of blanks and marks of the cut is no sentence.
    some = F.filter(F.transform("paras", lambda x, k: F.when(F.trim(F.translate(x, "\x01\x02", "  ")) != "", k + 1)), lambda k: k.isNotNull())
    held = T.exploded(cut, ["doc_id", "paras"], F.array(some), "some").where(F.size("some") > 0)
    each = F.transform(F.slice("some", 1, 4), lambda k: F.transform(F.slice(T.sentences(F.element_at("paras", k)), 1, 4), lambda s, n: F.struct(k.alias("para"), (n + 1).alias("sent"))))
    early = held.select("doc_id", F.array_max("some").alias("last"), F.slice(F.flatten(each), 1, 4).alias("first"))
    return early.groupBy("doc_id").agg(F.max("last").alias("last"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 4).alias("first"))


def phrase_hits(docs: DataFrame, rules: tuple[Phrases, ...] = PHRASES, settings: Settings = Settings()) -> DataFrame:
    """doc_id, rule, para, sent and phrase of each sentence's first phrase of each rule, as whole words.

    Sentences are cut into words once; those with the longest word of some phrase are kept, and their words that begin
    a phrase are joined with the phrases. The lists are fixed and small, so that side is broadcast.
    """
    rows = [(r.rule, k, p.split(), len(p.split()), r.where, r.lang) for r in rules if settings.limit(r.rule, r.limits) is not None for k, p in enumerate(r.phrases)]
    lexicon = docs.sparkSession.createDataFrame(rows, "rule string, ordinal int, parts array<string>, size int, place string, language string")
    firsts, longest, most = sorted({x[2][0] for x in rows}), sorted({max(x[2], key=len) for x in rows}), max((x[3] for x in rows), default=1)
    spoken = docs.where(F.col("lang").isin(*sorted({x[5] for x in rows}))).select("doc_id", "lang", "text")
    # Words are looked up in a set: a search of the text for each phrase costs more than cutting it.
    words = T.exploded(model.sentences(spoken), ["doc_id", "lang", "para", "sent"], F.array(T.bare_words(F.col("text"))), "words").where(F.exists("words", lambda w: w.isin(*longest)))
    spots = F.transform("words", lambda w, k: F.when(w.isin(*firsts), F.struct(k.alias("pos"), w.alias("word"), F.slice("words", k + 1, most).alias("next"))))
    each = T.exploded(words, ["doc_id", "lang", "para", "sent"], F.filter(spots, lambda x: x.isNotNull()), "s").select("doc_id", "lang", "para", "sent", "s.*")
    joined = each.join(F.broadcast(lexicon.withColumn("word", F.col("parts")[0])), "word").where(F.col("lang") == F.col("language"))
    matched = joined.where((F.slice("next", F.lit(1), F.col("size")) == F.col("parts")) & ((F.col("place") != "start") | (F.col("pos") == 0)))
    placed = matched.select("doc_id", "rule", "place", "para", "sent", "ordinal", "parts")
    if any(x[4] in ("opening", "closing") for x in rows):
        inside = F.when(F.col("place") == "opening", F.array_contains("first", F.struct("para", "sent"))).when(F.col("place") == "closing", F.col("para") == F.col("last")).otherwise(True)
        placed = placed.join(_bounds(docs), "doc_id").where(inside)
    hits = placed.groupBy("doc_id", "rule", "para", "sent").agg(F.min(F.struct("ordinal", "parts")).alias("m"))
    return hits.select("doc_id", "rule", "para", "sent", F.array_join("m.parts", " ").alias("phrase"))


def phrase_findings(docs: DataFrame, rules: tuple[Phrases, ...] = PHRASES, settings: Settings = Settings()) -> DataFrame:
    """One row for each rule and document whose sentences hit meet its bound."""
    live = [r for r in rules if settings.limit(r.rule, r.limits) is not None]
    bounds = docs.sparkSession.createDataFrame([(r.rule, float(settings.limit(r.rule, r.limits)), r.kind, r.severity) for r in live], "rule string, bound double, kind string, severity string")
    hits = phrase_hits(docs, rules, settings).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min(F.struct("para", "sent", "phrase")).alias("m"))
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))
    counted = hits.join(F.broadcast(bounds), "rule").join(sizes, "doc_id")
    density = F.round(F.col("n") * 1000.0 / F.col("n_words"))
    fires = F.when(F.col("kind") == "least", F.col("n") >= F.col("bound")).when(F.col("kind") == "above", F.col("n") > F.col("bound")).otherwise((F.col("n_words") >= LEAST_WORDS) & (density > F.col("bound")))
    return counted.where(fires).select("doc_id", "rule", "severity", "n", F.col("m.phrase").alias("quote"))


def form_findings(docs: DataFrame, rules: tuple[Forms, ...] = FORMS, settings: Settings = Settings()) -> DataFrame:
    """The rarer of two ways to write in each document, while the rule's bound holds; ties are silent but for `least`."""
    live = [(k, r, limit) for k, r in enumerate(rules) if (limit := settings.limit(r.rule, r.limits)) is not None]
    # No rule reports a text that lacks one of its forms: the first is counted where the second is there.
    second = _searched(docs).select("*", *(_count(r.second, f"{r.rule}/2", r.lang).alias(f"b{k}") for k, r, _ in live))
    first = (F.when(F.col(f"b{k}") > 0, _count(r.first, f"{r.rule}/1", r.lang)).otherwise(0).alias(f"a{k}") for k, r, _ in live)
    counted = second.select("doc_id", "text", *first, *(f"b{k}" for k, _, _ in live))
    rows = []
    for k, r, limit in live:
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        minority, total = F.least(a, b), a + b
        if r.bound == "least":
            fires = minority >= F.greatest(F.lit(limit), F.lit(1))
        elif r.bound == "count":
            fires = (minority > 0) & (minority <= limit) & (a != b)
        else:
            fires = (minority > 0) & (minority * 100 <= total * limit) & (a != b)
        rows.append(F.when(fires, _row(r, minority, F.when(a <= b, _quote(r.first)).otherwise(_quote(r.second)))))
    return _found(counted, rows)


def not_run(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, rule and reason for every rule that a document was not checked against."""
    rules = (*PATTERNS, *PHRASES, *FORMS)

    def reason(r) -> Column:
        why = F.when(F.lit(settings.limit(r.rule, r.limits) is None), "level is off").when(F.col("text").isNull(), "no text")
        if getattr(r, "lang", None) is not None:
            why = why.when(~F.col("lang").eqNullSafe(F.lit(r.lang)), "other language")
        return F.when(why.isNotNull(), F.struct(F.lit(r.rule).alias("rule"), why.alias("reason")))

    return T.exploded(docs, ["doc_id"], F.filter(F.array(*map(reason, rules)), lambda x: x.isNotNull()), "r").select("doc_id", "r.*")


def findings(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All families together."""
    from docaudit.operators import structure

    return _union([f.select(*COLUMNS) for f in (pattern_findings(docs, settings=settings), phrase_findings(docs, settings=settings), form_findings(docs, settings=settings), structure.findings(docs, settings))])


def composite(found: DataFrame, signals: tuple[str, ...], least: int = 3) -> DataFrame:
    """doc_id, n and rules of documents with at least `least` different signals among their findings."""
    kept = found.where(F.col("rule").isin(*signals)).groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return kept.where(F.size("rules") >= least).select("doc_id", F.size("rules").cast("bigint").alias("n"), F.array_join("rules", ",").alias("rules"))


def fingerprinted(found: DataFrame) -> DataFrame:
    """Adds the fingerprint by which a baseline knows a finding again."""
    return found.withColumn("fingerprint", T.fingerprint(F.col("doc_id"), F.col("rule"), F.coalesce("quote", F.lit(""))))


def fresh(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline lacks."""
    return fingerprinted(found).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def shelved(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return fingerprinted(found).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")


def pruned(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline rows that no finding has any more are dropped."""
    return baseline.join(fingerprinted(found).select("fingerprint").distinct(), "fingerprint", "left_semi")
