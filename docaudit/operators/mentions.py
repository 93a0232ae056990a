"""Dates, times, numbers and other mentions in text, and the rules that compare them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T

#: Fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
UNITS = {"mm": ("length", 0.001), "cm": ("length", 0.01), "m": ("length", 1.0), "km": ("length", 1000.0), "g": ("mass", 0.001), "kg": ("mass", 1.0), "t": ("mass", 1000.0), "MB": ("data", 1.0), "GB": ("data", 1000.0), "TB": ("data", 1000000.0)}

_MONTH = "|".join(MONTHS)
_DAY = "|".join(DAYS)
_ISO = "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b"
_LONG = f"\\b(?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}}\\b"
_BRITISH = f"\\b[0-9]{{1,2}} (?:{_MONTH}) [0-9]{{4}}\\b"


def month_number(name: Column) -> Column:
    return F.coalesce(*(F.when(name == m, k) for k, m in enumerate(MONTHS, 1)))


def date_of(raw: Column) -> Column:
    """The day that a written date names; null if the calendar has no such day."""
    month = month_number(F.regexp_extract(raw, f"({_MONTH})", 1))
    year = F.regexp_extract(raw, "([0-9]{4})", 1)
    day = F.regexp_extract(raw, "(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)", 1)
    named = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(F.when(raw.rlike("^[0-9]{4}-"), raw).otherwise(named), "yyyy-MM-dd")


#: What the rules are told of a text: a fact with a kind and a key is judged with those of its document that have the same; one without a kind is a finding, its key the rule.
FACT = "struct<kind:string,key:string,para:int,sent:int,nth:int,raw:string,day:date,n:double>"
_ONE = f"(?:{_ISO}|{_LONG}|{_BRITISH})"
_LABEL, _AGAIN = "\x01", "\x02"


def _fact(kind: str, key: Column, para: Column, raw: Column, sent: Column | None = None, nth: Column | None = None, day: Column | None = None, n: Column | None = None) -> Column:
    null = F.lit(None)
    parts = {"kind": (F.lit(kind), "string"), "key": (key, "string"), "para": (para, "int"), "sent": (null if sent is None else sent, "int"), "nth": (null if nth is None else nth, "int"), "raw": (raw, "string"), "day": (null if day is None else day, "date"), "n": (null if n is None else n, "double")}
    return F.struct(*(c.cast(t).alias(name) for name, (c, t) in parts.items()))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _if(guard: Column, found: Column) -> Column:
    """The array where the guard holds, which spares most texts the search; else none."""
    return F.when(guard, found).otherwise(F.array().cast("array<string>"))


def _none() -> Column:
    return F.lit(None).cast(f"array<{FACT}>")


def _joined(*facts: Column) -> Column:
    """Facts of all the arrays there are."""
    return F.flatten(F.array_compact(F.array(*facts)))


def impossible_date(text: Column, dates: Column) -> Column:
    return F.transform(F.filter(dates, lambda d: d["day"].isNull()), lambda d: d["raw"])


def date_weekday_mismatch(text: Column, dates: Column) -> Column:
    """A weekday beside a date that falls on another."""

    def off(raw: Column) -> Column:
        said = F.regexp_extract(raw, f"^({_DAY})", 1)
        number = F.coalesce(*(F.when(said == d, k) for k, d in enumerate(DAYS, 1)))
        return F.dayofweek(date_of(F.regexp_replace(raw, f"^(?:{_DAY}),? ", ""))) != number

    return _if(F.size(dates) > 0, F.filter(_all(text, f"((?:{_DAY}),? {_ONE})"), off))


def date_range_reversed(text: Column, dates: Column) -> Column:
    """A period that ends before it starts."""

    def reversed_(raw: Column) -> Column:
        return T.held(_all(raw, f"({_ONE})"), lambda both: date_of(F.get(both, F.lit(1))) < date_of(F.get(both, F.lit(0))))

    return _if(F.size(dates) > 0, F.filter(_all(text, f"({_ONE} ?(?:to|until|–|-) ?{_ONE})"), reversed_))


def duration_mismatch(text: Column, dates: Column) -> Column:
    """A start, a number of days and an end in one sentence that do not agree, counted with or without the first day."""
    gap = F.date_diff(F.get(dates, F.lit(1))["day"], F.get(dates, F.lit(0))["day"])
    n = F.regexp_extract(text, "\\b([0-9]{1,3})[- ]days?\\b", 1).try_cast("int")
    return _if((F.size(dates) == 2) & (gap != n) & (gap + 1 != n), F.array(text))


def amount_range_reversed(text: Column, dates: Column) -> Column:
    value = lambda x, k: F.regexp_replace(F.get(_all(x, "([0-9][0-9,]*(?:\\.[0-9]+)?)"), F.lit(k)), ",", "").try_cast("decimal(18,4)")
    found = _all(text, "([$€£][0-9][0-9,]*(?:\\.[0-9]+)? ?(?:–|-|to) ?[$€£][0-9][0-9,]*(?:\\.[0-9]+)?)")
    return _if(text.rlike("[$€£][0-9]"), F.filter(found, lambda x: value(x, 1) < value(x, 0)))


def quantity_range_reversed(text: Column, dates: Column) -> Column:
    value = lambda x, k: F.get(_all(x, "([0-9]+(?:\\.[0-9]+)?)"), F.lit(k)).cast("double")
    return F.filter(_all(text, "\\b([0-9]+(?:\\.[0-9]+)? ?(?:–|to) ?[0-9]+(?:\\.[0-9]+)? ?(?:mm|cm|m|km|g|kg|GB|MB|°C))\\b"), lambda x: value(x, 1) < value(x, 0))


def time_range_reversed(text: Column, dates: Column) -> Column:
    """A clock range without am or pm that ends before it starts; one past midnight, ending before six, is none."""
    part = lambda x, k: F.get(_all(x, "([0-9]{1,2})"), F.lit(k)).cast("int")
    found = _all(text, "\\b([0-2]?[0-9]:[0-5][0-9] ?(?:–|-|to) ?[0-2]?[0-9]:[0-5][0-9])\\b")
    return _if(F.contains(text, F.lit(":")), F.filter(found, lambda x: (part(x, 2) * 60 + part(x, 3) < part(x, 0) * 60 + part(x, 1)) & (part(x, 2) >= 6)))


def number_word_figure_mismatch(text: Column, dates: Column) -> Column:
    words = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirty", "sixty", "ninety")
    values = (*range(1, 13), 30, 60, 90)

    def off(quote: Column) -> Column:
        word = F.lower(F.regexp_extract(quote, "^([A-Za-z]+)", 1))
        return F.coalesce(*(F.when(word == w, v) for w, v in zip(words, values))) != F.regexp_extract(quote, "([0-9]+)", 1).try_cast("decimal(38,0)")

    return _if(F.contains(text, F.lit("(")), F.filter(_all(text, f"(?i)\\b((?:{'|'.join(words)}) \\([0-9]+\\))"), off))


def duration_product_mismatch(text: Column, dates: Column) -> Column:
    """"N sessions of M minutes" with a total that is not N times M."""
    pattern = "(?i)\\b([0-9]+) (?:sessions|classes|rounds|lessons|payments) of \\$?([0-9]+)(?: minutes| hours| days)?[^.!?\\n]{0,60}?\\b(?:total|in all|altogether)[^0-9.!?\\n]{0,20}\\$?([0-9]+)"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("bigint")
    return _if(F.when(text.rlike(pattern), F.try_multiply(part(1), part(2)) != part(3)), F.array(text))


def change_rate_mismatch(text: Column, dates: Column) -> Column:
    """"From A to B, up N%" where A and B give another rate, by more than half a point."""
    pattern = "(?i)from \\$?([0-9][0-9,]*(?:\\.[0-9]+)?) to \\$?([0-9][0-9,]*(?:\\.[0-9]+)?)[^.!?\\n]{0,40}?\\b(up|down|increase of|rise of|drop of|fall of|decrease of) (?:by )?([0-9]+(?:\\.[0-9]+)?)%"
    part = lambda k: F.regexp_replace(F.regexp_extract(text, pattern, k), ",", "").cast("double")
    rate = F.abs(part(2) - part(1)) / F.nullif(part(1), F.lit(0.0)) * 100
    up = F.lower(F.regexp_extract(text, pattern, 3)).isin("up", "increase of", "rise of")
    return _if(F.when(F.contains(text, F.lit("%")) & text.rlike(pattern), (F.abs(rate - part(4)) > 0.55) | (up != (part(2) > part(1)))), F.array(text))


def percent_sum_mismatch(text: Column) -> Column:
    """Paragraphs that speak of a breakdown and whose three or more percentages do not add up to 100 within rounding."""

    def off(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
        return (F.size(p) >= 3) & (F.abs(total - 100) > 0.5 * F.size(p)) & (total > 80) & (total < 120)

    speaks = F.contains(text, F.lit("%")) & text.rlike("(?i)break(?:s)? ?down|split|shares|respectively")
    return _if(F.when(speaks, T.held(F.transform(_all(text, "([0-9]+(?:\\.[0-9]+)?)%"), lambda x: x.cast("double")), off)), F.array(text))


_TERM = "\\((?:the |each,? an? )?[\"“]([A-Z][\\p{L} ]{2,40})[\"”]\\)"


def use_before_definition(text: Column, terms: Column) -> Column:
    """Terms defined in passing, as in (the "Seller"), that are used before."""

    def early(term: Column) -> Column:
        defined = F.greatest(F.instr(text, F.concat(F.lit('"'), term, F.lit('")'))), F.instr(text, F.concat(F.lit("“"), term, F.lit("”)"))))
        return F.regexp_instr(text, F.concat(F.lit("\\b"), term, F.lit("\\b"))) < defined - 4

    return F.filter(F.array_distinct(terms), early)


def unused_definition(text: Column, terms: Column) -> Column:
    return F.filter(terms, lambda term: F.regexp_count(text, F.concat(F.lit("\\b"), term, F.lit("\\b"))) == 1)


def _swaps(digits: Column) -> Column:
    """The number with each two neighbouring digits swapped."""
    return F.transform(F.sequence(F.lit(1), F.length(digits) - 1), lambda k: F.concat(F.substring(digits, F.lit(1), k - 1), F.substring(digits, k + 1, F.lit(1)), F.substring(digits, k, F.lit(1)), F.substring(digits, k + 2, F.length(digits))))


def _days(items: Column) -> Column:
    return F.filter(items, lambda x: x["day"].isNotNull())


def relative_date_mismatch(items: Column) -> Column:
    """"N days (weeks) later, on" a date that is not so far from the date before it in the paragraph."""
    said = F.filter(items, lambda x: x["raw"] == _AGAIN)

    def judged(days: Column) -> Column:
        def off(d: Column, k: Column) -> Column:
            before = F.get(days, k - 1)
            return (d["nth"] == 0) & (k > 0) & (before["para"] == d["para"]) & F.exists(said, lambda s: (s["para"] == d["para"]) & (s["sent"] == d["sent"]) & (F.date_diff(d["day"], before["day"]) != s["n"]))

        return F.filter(days, off)

    return F.transform(F.when(F.size(said) > 0, T.held(_days(items), judged)), lambda d: F.struct(d["para"], d["raw"].alias("quote")))


def date_without_year(items: Column) -> Column:
    """Dates without a year where the document's other dates span years."""
    years = F.array_distinct(F.transform(_days(items), lambda d: F.year(d["day"])))
    found = F.filter(items, lambda x: x["day"].isNull() & x["nth"].isNull() & (x["raw"] != _AGAIN))
    return F.transform(F.when((F.size(found) > 0) & (F.size(years) > 1), found), lambda x: F.struct(x["para"], x["raw"].alias("quote")))


def date_order(items: Column) -> Column:
    """Dates that open paragraphs in a row and step against the direction of most of them."""

    def judged(own: Column) -> Column:
        steps = F.transform(own, lambda d, k: F.when(k > 0, F.signum(F.date_diff(d["day"], F.get(own, k - 1)["day"]).cast("double"))))
        return T.held(F.signum(F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))), lambda way: F.filter(F.zip_with(own, steps, lambda d, x: F.struct(d["para"].alias("para"), d["raw"].alias("quote"), x.alias("step"))), lambda x: (F.size(own) >= 4) & (x["step"] * way < 0)))

    return F.transform(T.held(F.filter(_days(items), lambda d: (d["nth"] == 0) & (d["sent"] == 1)), judged), lambda x: F.struct(x["para"], x["quote"]))


def _first(quote: Column) -> Column:
    """A finding of a document's text as a whole, under its first paragraph."""
    return F.array(F.struct(F.lit(1).alias("para"), quote.alias("quote")))


def acronym_expansion_conflict(items: Column) -> Column:
    """An abbreviation spelled out as two names in one document."""
    return F.when(F.size(F.array_distinct(items["raw"])) > 1, _first(F.col("key")))


def duplicate_definition(items: Column) -> Column:
    return F.when(F.size(items) > 1, _first(F.col("key")))


def phone_number_variant(items: Column) -> Column:
    """Numbers of one document that differ by two neighbouring digits swapped."""

    def judged(own: Column) -> Column:
        turned = F.flatten(F.transform(own, lambda one: F.filter(_swaps(one), lambda x: x > one)))
        pairs = lambda other: F.transform(F.filter(F.array_intersect(_swaps(other), own), lambda one: one < other), lambda one: F.struct(F.lit(1).alias("para"), F.concat_ws(" / ", one, other).alias("quote")))
        return F.flatten(F.transform(F.array_intersect(turned, own), pairs))

    return T.held(F.array_distinct(items["raw"]), judged)


def unit_mismatch(items: Column) -> Column:
    """The same labelled item in two units that do not convert into each other, by more than one per cent."""
    off = (F.size(F.array_distinct(items["raw"])) > 1) & (F.array_max(items["n"]) > F.array_min(items["n"]) * 1.01)
    return F.when(off, F.array(F.struct(F.array_min(items["para"]).alias("para"), F.substring_index("key", _LABEL, 1).alias("quote"))))


def fact_conflict(items: Column) -> Column:
    """Labels of a document with just two different values."""
    return F.when(F.size(F.array_distinct(items["raw"])) == 2, F.array(F.struct(F.array_max(items["para"]).alias("para"), F.col("key").alias("quote"))))


_LABELLED = "^[-*\\s]*([A-Z][\\p{L} ]{2,30}): +(\\S.{0,60})$"


def labelled_facts(docs: DataFrame) -> DataFrame:
    """doc_id, para, label and value of "Label: value" lines."""
    from docaudit.plans import model

    own = model.paragraphs(docs.where(F.contains("text", F.lit(": ")))).where(F.col("text").rlike(_LABELLED))
    return own.select("doc_id", "para", F.lower(F.trim(F.regexp_extract("text", _LABELLED, 1))).alias("label"), F.trim(F.regexp_extract("text", _LABELLED, 2)).alias("value"))


def cross_doc_fact_conflict(docs: DataFrame) -> DataFrame:
    """Labels with just two values over the documents, reported in those that have the rarer one; a tie names the later."""
    votes = labelled_facts(docs).groupBy("doc_id", "label").agg(F.min("value").alias("value"), F.count_distinct("value").alias("own"), F.min("para").alias("para")).where("own = 1")
    counts = votes.groupBy("label", "value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "first"))
    ranked = counts.withColumns({"place": place, "values": F.count("*").over(Window.partitionBy("label"))})
    rare = ranked.where("values = 2 AND place = 2").select("label", "value")
    return votes.join(rare, ["label", "value"]).select("doc_id", "para", F.col("label").alias("quote"))


def _named(*rules) -> dict:
    return {f.__name__.replace("_", "-"): f for f in rules}


#: Rules by what they read: a sentence and its dates, a paragraph, a text and the terms it defines, the facts of a kind and key of a document, all documents.
IN_SENTENCE = _named(impossible_date, date_weekday_mismatch, date_range_reversed, duration_mismatch, amount_range_reversed, quantity_range_reversed, time_range_reversed, number_word_figure_mismatch, duration_product_mismatch, change_rate_mismatch)
IN_PARAGRAPH = _named(percent_sum_mismatch)
IN_TEXT = _named(use_before_definition, unused_definition)
JUDGED = {
    "date": _named(relative_date_mismatch, date_without_year, date_order), "acronym": _named(acronym_expansion_conflict), "term": _named(duplicate_definition), "phone": _named(phone_number_variant),
    "unit": _named(unit_mismatch), "fact": _named(fact_conflict),
}
OVER_ALL = _named(cross_doc_fact_conflict)
RULES = {**IN_SENTENCE, **IN_PARAGRAPH, **IN_TEXT, **{r: f for kind in JUDGED.values() for r, f in kind.items()}, **OVER_ALL}


def _found(rules: dict, asked: set[str], para: Column, *of: Column) -> list[Column]:
    return [_as_facts(r, f(*of), para) for r, f in rules.items() if r in asked]


def _as_facts(rule: str, quotes: Column, para: Column) -> Column:
    return F.transform(quotes, lambda x: _fact("", F.lit(rule), para, x))


def _of_sentence(text: Column, para: Column, sent: Column, asked: set[str]) -> Column:
    def told(dates: Column) -> Column:
        facts = _found(IN_SENTENCE, asked, para, text, dates)
        if asked & set(JUDGED["date"]):
            facts.append(F.transform(dates, lambda d, k: _fact("date", F.lit(""), para, d["raw"], sent, k, d["day"])))
            later = "\\b([0-9]{1,3}) (day|week)s? later"
            days = F.regexp_extract(text, later, 1).cast("double") * F.when(F.regexp_extract(text, later, 2) == "week", 7).otherwise(1)
            facts.append(F.when(F.contains(text, F.lit(" later")) & text.rlike(later), F.array(_fact("date", F.lit(""), para, F.lit(_AGAIN), sent, n=days))))
            bare = _all(text, f"\\b((?:{_MONTH}) [0-9]{{1,2}})(?![0-9,]|, [0-9]{{4}})")
            facts.append(F.transform(bare, lambda x: _fact("date", F.lit(""), para, x, sent)))
        return _joined(*facts, _none())

    dates = F.transform(_if(text.rlike("[0-9]{4}"), _all(text, f"({_ISO}|{_LONG}|{_BRITISH})")), lambda x: F.struct(x.alias("raw"), date_of(x).alias("day")))
    return F.when(text.rlike("[0-9]"), T.held(dates, told))


def _of_paragraph(text: Column, para: Column, asked: set[str]) -> Column:
    facts = [F.flatten(F.array_compact(F.transform(T.sentences(text), lambda s, k: _of_sentence(s, para, k + 1, asked)))), *_found(IN_PARAGRAPH, asked, para, text)]
    if asked & set(JUDGED["unit"]):
        pattern = f"^([A-Z][\\p{{L}} ]{{2,30}}): ([0-9]+(?:\\.[0-9]+)?) ?({'|'.join(UNITS)})\\b"
        part = lambda k: F.regexp_extract(text, pattern, k)
        known = lambda k: F.coalesce(*(F.when(part(3) == u, x[k]) for u, x in UNITS.items()))
        facts.append(F.when(F.contains(text, F.lit(": ")) & text.rlike(pattern), F.array(_fact("unit", F.concat(F.lower(part(1)), F.lit(_LABEL), known(0)), para, part(3), n=part(2).cast("double") * known(1)))))
    if asked & set(JUDGED["fact"]):
        part_ = lambda k: F.trim(F.regexp_extract(text, _LABELLED, k))
        facts.append(F.when(F.contains(text, F.lit(": ")) & text.rlike(_LABELLED), F.array(_fact("fact", F.lower(part_(1)), para, part_(2)))))
    return _joined(*facts, _none())


def _of_text(text: Column, asked: set[str]) -> Column:
    one, facts = F.lit(1), []

    def defined(terms: Column) -> Column:
        own = _found(IN_TEXT, asked, one, text, terms)
        return _joined(*own, F.transform(terms, lambda x: _fact("term", x, one, x)) if asked & set(JUDGED["term"]) else _none(), _none())

    facts.append(F.when(F.contains(text, F.lit('")')) | F.contains(text, F.lit("”)")), T.held(_all(text, _TERM), defined)))
    if asked & set(JUDGED["acronym"]):
        name = lambda x: F.lower(F.regexp_replace(x, " \\(.*", ""))
        acronym = lambda x: F.regexp_extract(x, "\\(([A-Z]+)\\)", 1)
        initials = lambda x: F.upper(F.array_join(F.transform(F.split(name(x), " "), lambda w: F.substring(w, 1, 1)), ""))
        found = F.filter(_if(F.contains(text, F.lit("(")), _all(text, "((?:[A-Z][a-z]+ ){2,5}\\([A-Z]{2,5}\\))")), lambda x: initials(x).endswith(acronym(x)))
        facts.append(F.transform(found, lambda x: _fact("acronym", acronym(x), one, name(x))))
    if asked & set(JUDGED["phone"]):
        raw = F.filter(_all(text, "(\\+?[0-9][0-9() .-]{7,18}[0-9])"), lambda x: ~x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"))
        facts.append(F.transform(raw, lambda x: _fact("phone", F.lit(""), one, F.regexp_replace(x, "[^0-9]", ""))))
    paragraphs = F.flatten(F.transform(F.when(text.rlike("[0-9:]"), T.paragraphs(text)), lambda p, k: _of_paragraph(p, k + 1, asked)))
    return _joined(*facts, paragraphs, _none())


def findings(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """doc_id, rule, para and quote over the named rules.

    Texts are dealt by document and read once: what all rules are told of them is judged where it is.
    """
    asked = set(rules)
    dealt = docs.where("text IS NOT NULL").select("doc_id", "text").repartition(T.shares(docs), "doc_id")
    each = T.exploded(dealt, ["doc_id"], _of_text(F.col("text"), asked), "f")
    grouped = each.groupBy("doc_id", "f.kind", "f.key").agg(F.array_sort(F.collect_list(F.struct("f.para", "f.sent", "f.nth", "f.raw", "f.day", "f.n"))).alias("items"))

    def named(rule: Column, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(rule.alias("rule"), x["para"].cast("int").alias("para"), x["quote"].alias("quote")))

    made = [F.when(F.col("kind") == "", named(F.col("key"), F.transform("items", lambda x: F.struct(x["para"], x["raw"].alias("quote")))))]
    made += [F.when(F.col("kind") == kind, named(F.lit(r), f(F.col("items")))) for kind, own in JUDGED.items() for r, f in own.items() if r in asked]
    found = T.exploded(grouped, ["doc_id"], _joined(*made), "x").select("doc_id", "x.*")
    return reduce(DataFrame.unionByName, [OVER_ALL[r](docs).select("doc_id", F.lit(r).alias("rule"), "para", "quote") for r in OVER_ALL if r in asked], found)


def atoms(docs: DataFrame) -> DataFrame:
    """doc_id, kind, key, text and nth of the facts a text states, by ten readers; a later reader skips what an earlier took.

    Kinds: url, code, date, time, quote, footnote, reference, heading, number, name. The key is what makes two atoms
    the same fact: lower case, white space as one blank, no thousands separators.
    """
    # Each with what its matches hold one of, if literals say so; digits are searched for alone.
    digit = "[0-9]"
    readers = (
        ("url", "https?://[^\\s)>\\]]+", ("://",)), ("code", "`[^`\\n]+`", ("`",)), ("date", f"{_ISO}|{_LONG}|{_BRITISH}", digit), ("time", "\\b[0-2]?[0-9]:[0-5][0-9]\\b", (":",)), ("quote", "[“\"][^”\"\\n]{3,200}[”\"]", ("“", '"')),
        ("footnote", "\\[\\^[^\\]]+\\]", ("[^",)), ("reference", "\\b(?:Section|Article|Figure|Table) [0-9]+(?:\\.[0-9]+)*", ("Section ", "Article ", "Figure ", "Table ")), ("heading", "(?m)^#{1,6} [^\\n]+$", ("# ",)), ("number", "[$€£]?[0-9][0-9,]*(?:\\.[0-9]+)?%?", digit), ("name", "\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\\b", ()),
    )

    def read(rest: Column, left: tuple, told: tuple[Column, ...] = ()) -> Column:
        """What the readers tell of the rest, and what was told before; each reader's rest is made once."""
        kind, pattern, needs = left[0]
        there = rest.rlike(needs) if isinstance(needs, str) else reduce(Column.__or__, (F.contains(rest, F.lit(x)) for x in needs)) if needs else F.lit(True)
        own = F.transform(_if(there, _all(rest, f"({pattern})")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
        if not left[1:]:
            return F.concat(*told, own)
        return T.held(F.when(there, F.regexp_replace(rest, pattern, " ¤ ")).otherwise(rest), lambda x: read(x, left[1:], (*told, own)))

    dealt = docs.where("text IS NOT NULL").select("doc_id", "text").repartition(T.shares(docs), "doc_id")
    found = T.exploded(dealt, ["doc_id"], read(F.col("text"), readers), "a", "nth").select("doc_id", "nth", "a.kind", "a.text")
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", "(?<=[0-9]),(?=[0-9]{3})", ""), "\\s+", " ")))
    return found.withColumn("key", key).select("doc_id", "kind", "key", "text", "nth")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference of the atoms of two versions of documents: doc_id, kind, key, text and outcome.

    Equal texts cancel out; of the rest, equal keys pair as reformed; what is left was dropped or added.
    """

    def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("nth")))

    same = ["doc_id", "kind", "key", "text"]
    a, b = numbered(atoms(before), same, "k"), numbered(atoms(after), same, "k")
    left, right = a.join(b.select(*same, "k"), [*same, "k"], "left_anti"), b.join(a.select(*same, "k"), [*same, "k"], "left_anti")
    keyed = ["doc_id", "kind", "key"]
    left, right = numbered(left, keyed, "r").drop("k", "nth"), numbered(right, keyed, "r").drop("k", "nth").withColumnRenamed("text", "now")
    joined = left.join(right, [*keyed, "r"], "full_outer")
    outcome = F.when(F.col("text").isNull(), "added").when(F.col("now").isNull(), "dropped").otherwise("reformed")
    return joined.select(*keyed, F.coalesce("text", "now").alias("text"), outcome.alias("outcome"))


#: Characters of quotations that one automaton holds.
QUOTES_HELD = 2_000_000
#: Characters of a quotation's beginning that the automaton holds.
BEGINNING = 8


def cite(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quote_id and outcome of quotations: ok, quote-elsewhere, quote-not-found or missing-address.

    quotes(quote_id, doc_id, quote) names the source; texts are compared in NFKC and lower case without white space,
    wherever a quotation begins. One of white space alone, or null, is in no source. A quotation whose own source lacks
    it is looked for in all. missing-address: the source is not there, or has no text. Sources with one id are one.
    """
    own = quotes.select("quote_id", "doc_id", T.folded(F.col("quote")).alias("key"))
    named = own.select("doc_id", "key").where("key <> ''").distinct()
    there = sources.where("text IS NOT NULL").select("doc_id").distinct().withColumn("there", F.lit(True))
    met = named.join(sources.where("text IS NOT NULL").select("doc_id", T.folded(F.col("text")).alias("body")), "doc_id")
    held = met.where(F.contains("body", F.col("key"))).select("doc_id", "key").distinct().withColumn("ok", F.lit(True))
    direct = own.join(there, "doc_id", "left").join(held, ["doc_id", "key"], "left")
    found = held_anywhere(direct.where("there AND ok IS NULL AND key <> ''").select("key"), sources).withColumn("seen", F.lit(True))
    outcome = F.when(F.col("there").isNull(), "missing-address").when(F.col("ok"), "ok").when(F.col("seen"), "quote-elsewhere").otherwise("quote-not-found")
    return direct.join(found, "key", "left").select("quote_id", outcome.alias("outcome"))


def held_anywhere(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """Those keys (folded, not empty) that the folded text of any source holds at any place, each once.

    Keys are searched for all at once by an automaton, in blocks of QUOTES_HELD characters: a stated set of queries,
    whose blocks each read the sources once. A key longer than that is a block of its own.
    """
    texts, out, block, size = sources.where("text IS NOT NULL").select("text"), None, [], 0
    for (key,) in keys.distinct().toLocalIterator():
        if block and size + len(key) > QUOTES_HELD:
            found = _searched(texts, block)
            out, block, size = found if out is None else out.unionByName(found), [], 0
        block.append(key)
        size += len(key)
    if block:
        found = _searched(texts, block)
        out = found if out is None else out.unionByName(found)
    return keys.sparkSession.createDataFrame([], "key string") if out is None else out.distinct()


def _searched(texts: DataFrame, keys: list[str]) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(keys)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        # The automaton holds the beginnings of the keys, which they share; the rest is looked up by length.
        begun: dict[str, dict[int, dict[str, int]]] = {}
        for k, key in enumerate(held.value):
            begun.setdefault(key[:BEGINNING], {}).setdefault(len(key), {})[key] = k
        automaton = ahocorasick.Automaton()
        for start, sized in begun.items():
            automaton.add_word(start, (len(start), sized))
        automaton.make_automaton()
        seen: set[int] = set()
        for batch in found:
            before = set(seen)
            for value in batch.column(0):
                text = T.fold(value.as_py())
                for end, (own, sized) in automaton.iter(text):
                    at = end + 1 - own
                    for size, whole in sized.items():
                        k = whole.get(text[at : at + size])
                        if k is not None:
                            seen.add(k)
            yield pa.RecordBatch.from_pydict({"key": [held.value[k] for k in sorted(seen - before)]}, schema=pa.schema([("key", pa.string())]))

    return texts.mapInArrow(run, "key string")
