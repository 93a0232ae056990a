"""Figures of a document that do not fit each other: balances, pay, rates, readings, capacities and stated limits.

Lines of a label and a figure ("Gross pay: 2,400.00", "| Gross pay | 2,400.00 |") are read once for each document, in
its own row, and put together to statements for a batch of documents at once; every rule names the figures it needs by their labels and states what must hold among them. A rule whose
figures a document lacks says nothing. No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as T

#: Lines of a label and a figure; what a line holds of both is left with a mark between.
_FACT = "\x01"
_FACTS = r"(?dm)^(?=[^\n]*?[A-Za-z][ )*]*[:|][^0-9\n]*[0-9])(?:[^\S\n]|[|*-])*([A-Za-z][A-Za-z ()/-]*?)[ *]*[:|](?:[^\S\n]|\*)*([-+]?[$€£¥]?[0-9][0-9,]*(?:\.[0-9]+)?)[^\n]*"

#: Figures by the labels that name them, without brackets: the first such line counts.
FIGURES: dict[str, tuple[str, ...]] = {
    "opening": ("opening balance", "beginning balance", "previous balance", "balance brought forward"),
    "deposits": ("deposits", "deposit received", "total deposits", "credits", "total credits", "payments received"),
    "withdrawals": ("withdrawals", "withdrawal", "total withdrawals", "debits", "total debits"),
    "closing": ("closing balance", "ending balance", "new balance"),
    "gross pay": ("gross pay", "gross salary", "gross wages", "gross earnings"),
    "deductions": ("total deductions",),
    "net pay": ("net pay", "net salary", "net wages", "net earnings"),
    "monthly pay": ("monthly pay", "monthly salary"),
    "bonus months": ("bonus months", "months of bonus"),
    "annual pay": ("annual pay", "annual salary", "yearly pay", "yearly salary"),
    "interest balance": ("principal", "average principal", "balance subject to interest", "loan balance"),
    "interest rate": ("interest rate", "annual interest rate"),
    "interest": ("interest", "interest charged", "interest due"),
    "payments": ("number of payments", "number of installments", "number of instalments"),
    "payment": ("monthly payment", "payment amount", "installment", "instalment"),
    "fee": ("installment fee", "instalment fee", "processing fee", "arrangement fee"),
    "payment total": ("total of payments", "total payments", "total payable"),
    "rent": ("rent", "monthly rent"),
    "deposit months": ("deposit months", "security deposit months"),
    "deposit": ("deposit", "deposit amount", "security deposit"),
    "sales": ("sales", "net sales", "revenue", "net revenue"),
    "profit": ("profit", "operating profit", "net profit", "gross profit"),
    "margin": ("margin", "profit margin", "operating margin", "net margin", "gross margin"),
    "bill total": ("total medical cost", "total medical expenses", "bill total", "total charges"),
    "share": ("patient share", "your share", "copayment share", "patient rate", "copayment rate"),
    "paid": ("amount paid", "patient pays", "you pay"),
    "height": ("height",),
    "weight": ("weight", "body weight"),
    "bmi": ("bmi",),
    "battery": ("battery capacity wh", "capacity wh"),
    "consumption": ("consumption", "consumption w", "power consumption", "power consumption w"),
    "runtime": ("runtime", "runtime h", "runtime hours", "battery life", "battery life hours"),
    "seats": ("capacity", "seating capacity", "room capacity", "maximum capacity"),
    "registered": ("registered", "attendees", "participants", "registrations"),
    "net weight": ("net weight",),
    "gross weight": ("gross weight",),
    "reading before": ("previous reading", "previous meter reading"),
    "reading now": ("current reading", "current meter reading", "present reading", "present meter reading"),
    "usage": ("usage", "units used", "consumption billed"),
    "deductible": ("deductible", "excess"),
    "benefit limit": ("benefit limit", "coverage limit", "cover limit", "maximum benefit"),
    "dose": ("dose", "amount per use"),
    "doses a day": ("doses per day", "doses a day", "times per day", "times a day", "uses per day"),
    "daily maximum": ("daily maximum", "maximum per day", "maximum a day", "maximum daily dose"),
    "hours between": ("minimum interval", "minimum interval hours", "hours between doses"),
    "budget": ("budget",),
    "actual": ("actual",),
    "variance": ("variance",),
}
#: Of these all lines are summed.
SUMMED = ("deposits", "withdrawals", "deductions")


class Figures:
    """The figures of a statement by their names: value and half a step of the last digit written."""

    def __init__(self, statement: Column):
        self.statement = statement

    def there(self, name: str) -> Column:
        return F.array_contains(self.statement["said"], F.lit(name))

    def own(self, name: str) -> Column:
        return F.array_contains(self.statement["own"], F.lit(name))

    def _of(self, name: str) -> Column:
        return F.get(self.statement["stated"], F.array_position(self.statement["said"], F.lit(name)).cast("int") - 1)

    def __call__(self, name: str) -> Column:
        return self._of(name)["value"]

    def half_step(self, name: str) -> Column:
        return self._of(name)["half_step"]

    def differs(self, want: Column, name: str) -> Column:
        """Whether the figure is not the wanted value at its own precision."""
        return F.abs(want - self(name)) > self.half_step(name) + 1e-6


@dataclass(frozen=True)
class Check:
    rule: str
    needs: tuple[str, ...]
    #: What is wrong if true, the value that was expected, and the figure it is compared with.
    wrong: Callable[[Figures], Column]
    want: Callable[[Figures], Column]
    severity: str = "warning"


def _is(rule: str, needs: tuple[str, ...], want: Callable[[Figures], Column], severity: str = "warning") -> Check:
    """The last figure must be `want` of the others."""
    return Check(rule, needs, lambda v: v.differs(want(v), needs[-1]), want, severity)


def _at_most(rule: str, needs: tuple[str, ...], want: Callable[[Figures], Column], slack: float = 0) -> Check:
    """The last figure must not be over `want`; slack: how many of its half steps do not count."""
    return Check(rule, needs, lambda v: v(needs[-1]) > want(v) + slack * v.half_step(needs[-1]) + 1e-6, want)


def _metres(v: Figures) -> Column:
    return F.when(v("height") > 3, v("height") / 100).otherwise(v("height"))


CHECKS = (
    _is("closing-balance-mismatch", ("opening", "deposits", "withdrawals", "closing"), lambda v: v("opening") + v("deposits") - v("withdrawals")),
    _is("net-amount-mismatch", ("gross pay", "deductions", "net pay"), lambda v: v("gross pay") - v("deductions")),
    _is("annual-pay-mismatch", ("monthly pay", "bonus months", "annual pay"), lambda v: v("monthly pay") * (12 + v("bonus months"))),
    # A year's interest, or a month's.
    Check("interest-mismatch", ("interest balance", "interest rate", "interest"), lambda v: v.differs(v("interest balance") * v("interest rate") / 100, "interest") & v.differs(v("interest balance") * v("interest rate") / 1200, "interest"), lambda v: v("interest balance") * v("interest rate") / 100),
    Check("installment-total-mismatch", ("payments", "payment", "payment total"), lambda v: v.differs(v("payments") * v("payment"), "payment total") & (~v.there("fee") | v.differs(v("payments") * v("payment") + v("fee"), "payment total")), lambda v: v("payments") * v("payment")),
    _is("rent-multiple-mismatch", ("rent", "deposit months", "deposit"), lambda v: v("rent") * v("deposit months")),
    _is("ratio-mismatch", ("profit", "sales", "margin"), lambda v: 100 * v("profit") / F.nullif(v("sales"), F.lit(0.0))),
    _is("share-amount-mismatch", ("bill total", "share", "paid"), lambda v: v("bill total") * v("share") / 100),
    _is("bmi-mismatch", ("height", "weight", "bmi"), lambda v: v("weight") / F.nullif(F.pow(_metres(v), F.lit(2)), F.lit(0.0))),
    _at_most("capacity-runtime-mismatch", ("battery", "consumption", "runtime"), lambda v: v("battery") / F.nullif(v("consumption"), F.lit(0.0)), slack=1),
    _at_most("count-over-capacity", ("seats", "registered"), lambda v: v("seats")),
    _at_most("net-over-gross", ("gross weight", "net weight"), lambda v: v("gross weight")),
    _is("meter-usage-mismatch", ("reading before", "reading now", "usage"), lambda v: v("reading now") - v("reading before"), "error"),
    _at_most("deductible-exceeds-limit", ("benefit limit", "deductible"), lambda v: v("benefit limit")),
    Check("product-exceeds-maximum", ("dose", "doses a day", "daily maximum"), lambda v: v("dose") * v("doses a day") > v("daily maximum") + 1e-6, lambda v: v("dose") * v("doses a day")),
    Check("interval-count-mismatch", ("hours between", "doses a day"), lambda v: v("doses a day") > F.floor(24 / F.nullif(v("hours between"), F.lit(0.0))), lambda v: F.floor(24 / F.nullif(v("hours between"), F.lit(0.0)))),
    Check("variance-mismatch", ("budget", "actual", "variance"), lambda v: v.differs(v("actual") - v("budget"), "variance") & v.differs(v("budget") - v("actual"), "variance"), lambda v: v("actual") - v("budget")),
)


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one run behind the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _facts(marked: pa.Array) -> tuple[np.ndarray, ...]:
    """Text, block (numbered through all texts), name, value and half step of the figures whose labels are known, in order."""
    names = list(FIGURES)
    known = {label: names.index(name) for name, labels in FIGURES.items() for label in labels}
    split = pc.split_pattern(marked, "\n")
    lines, text = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    apart = pc.equal(pc.ascii_trim(lines, " \t"), "").to_numpy(zero_copy_only=False)
    block = np.cumsum(apart | (np.diff(text, prepend=-1) != 0))
    at = np.flatnonzero(pc.match_substring(lines, _FACT).to_numpy(zero_copy_only=False))
    parts = pc.list_flatten(pc.split_pattern(lines.take(pa.array(at)), _FACT))
    label = pc.dictionary_encode(parts.take(pa.array(np.arange(0, 2 * len(at), 2))))
    plain = [re.sub(" +", " ", re.sub("[()]", "", x.lower())).strip(" ") for x in label.dictionary.to_pylist()]
    name = np.array([known.get(x, -1) for x in plain], np.int64)[label.indices.to_numpy()]
    own = np.flatnonzero(name >= 0)
    written = pc.replace_substring_regex(parts.take(pa.array(2 * own + 1)), "[$€£¥,+]", "")
    point = pc.find_substring(written, ".").to_numpy()
    digits = np.where(point >= 0, pc.binary_length(written).to_numpy() - point - 1, 0)
    try:
        value = pc.cast(written, pa.float64()).to_numpy()
    except pa.ArrowInvalid:  # beyond what a double holds
        value = np.array([float(x) for x in written.to_pylist()])
    return text[at][own], block[at][own], name[own], value, 0.5 * 10.0 ** -digits.astype(float)


def _statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and statements of each text with two figures or more; see figures()."""
    names, most = pa.array(list(FIGURES)), len(FIGURES)
    is_summed = np.isin(list(FIGURES), SUMMED)
    for batch in batches:
        text, block, name, value, half = _facts(batch.column("marked"))
        some = np.bincount(text, minlength=batch.num_rows)[text] > 1
        if not some.any():
            continue
        text, block, name, value, half = (x[some] for x in (text, block, name, value, half))
        new = np.diff(block, prepend=-1) != 0
        block, block_text = np.cumsum(new) - 1, text[new]
        # What a block says under one name is a group; its figures stand in a row from `first`.
        key = block * most + name
        order = np.argsort(key, kind="stable")
        key, value, half = key[order], value[order], half[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(np.append(first, len(key)))
        of_block, of_name = key[first] // most, key[first] % most
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights=value)
        times = np.ones(len(block_text), np.int64)
        counted = ~is_summed[of_name]
        np.maximum.at(times, of_block[counted], n[counted])
        # What one block alone says holds for the others of its text.
        _, nth_key, blocks = np.unique(block_text[of_block] * most + of_name, return_inverse=True, return_counts=True)
        once = np.flatnonzero(blocks[nth_key] == 1)
        begin, end = (np.searchsorted(block_text[of_block[once]], block_text, side) for side in ("left", "right"))
        into = np.repeat(np.arange(len(block_text)), end - begin)
        lent = once[np.repeat(begin, end - begin) + _runs(end - begin)]
        into, lent = into[of_block[lent] != into], lent[of_block[lent] != into]
        group, at = np.concatenate([np.arange(len(n)), lent]), np.concatenate([of_block, into])
        own = np.arange(len(group)) < len(n)
        # A group says one figure in each statement of the block.
        nth = _runs(times[at])
        group, own, at = (np.repeat(x, times[at]) for x in (group, own, at))
        sums = is_summed[of_name[group]]
        alike = own & sums & (times[at] > 1) & (n[group] == times[at])
        pick = np.where(alike | (own & ~sums & (n[group] > 1)), nth, 0)
        there = pick < n[group]
        place = np.where(there, first[group] + pick, 0)
        said = np.where(sums & ~alike, total[group], value[place])
        statement = (np.cumsum(times) - times)[at] + nth
        there = np.flatnonzero(there)[np.argsort(statement[there], kind="stable")]
        word = names.take(pa.array(of_name[group[there]]))
        sizes = np.bincount(statement[there], minlength=times.sum())
        stated = pa.StructArray.from_arrays([word, pa.array(said[there]), pa.array(half[place[there]])], ["name", "value", "half_step"])
        # The names of its block are the statement's own.
        groups = np.bincount(of_block, minlength=len(times))
        sizes_own = np.repeat(groups, times)
        owned = names.take(pa.array(of_name[np.repeat(np.repeat(np.cumsum(groups) - groups, times), sizes_own) + _runs(sizes_own)]))
        made = pa.StructArray.from_arrays([_lists(owned, sizes_own), _lists(word, sizes), _lists(stated, sizes)], ["own", "said", "stated"])
        texts, first_block = np.unique(block_text, return_index=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(texts)), _lists(made, np.add.reduceat(times, first_block))], ["doc_id", "statements"])


def _stated(docs: DataFrame) -> DataFrame:
    """doc_id and statements (own, said, stated) of each row that has two figures or more."""
    # One search of the text leaves label and figure of its lines; Python gets nulls for texts without.
    marked = F.regexp_replace(F.translate(T.plain(F.col("text")), _FACT, " "), _FACTS, f"$1{_FACT}$2")
    texts = docs.select("doc_id", F.when(F.contains(marked, F.lit(_FACT)), marked).alias("marked"))
    statement = "own: array<string>, said: array<string>, stated: array<struct<name: string, value: double, half_step: double>>"
    return texts.mapInArrow(_statements, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, statements array<struct<{statement}>>")


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and, for each statement, own (the names its block has), said, the names of its figures, and stated: name, value and half_step.

    Lines between blank ones are a block. Where a block says a label again, the second of each label are a statement of
    their own, and so on. What a statement lacks is taken from the document if one other block alone has it: a name at
    the top holds for all.
    """
    return T.exploded(_stated(docs), ["doc_id"], F.col("statements"), "s").select("doc_id", "s.*")


def figure_findings(docs: DataFrame, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """doc_id, rule, severity, n (1) and quote (what was expected and what is stated), a row for each wrong statement.

    Null texts, empty texts and texts without labelled figures have none; statements are what figures() gives, deposits,
    withdrawals and deductions of one are summed. Two statements of a document that say the same are reported once
    if their figures are the same lines. Repeated rows are each answered.
    """

    def wrong(statement: Column) -> Column:
        v = Figures(statement)
        rows = []
        for c in checks:
            there, own = F.lit(True), F.lit(False)
            for name in c.needs:
                there, own = there & v.there(name), own | v.own(name)
            quote = F.concat_ws(" ", F.lit(c.needs[-1]), F.format_string("%.2f", v(c.needs[-1])), F.lit("against"), F.format_string("%.2f", c.want(v).cast("double")))
            # A statement made of what other blocks say is theirs to report: the first block that has one of its figures does.
            rows.append(F.when(there & own & c.wrong(v), F.struct(F.lit(c.rule).alias("rule"), F.lit(c.severity).alias("severity"), F.lit(1).cast("bigint").alias("n"), quote.alias("quote"))))
        return F.filter(F.array(*rows), lambda x: x.isNotNull())

    # A row holds all statements of its text, so what they say alike meets without an exchange.
    found = F.array_distinct(F.flatten(F.transform("statements", wrong)))
    return T.exploded(_stated(docs), ["doc_id"], found, "f").select("doc_id", "f.*")


_UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
_UNITS = "day|week|month|year"


def _days(number: Column, unit: Column) -> Column:
    length = F.create_map(*(F.lit(x) for pair in _UNIT_DAYS.items() for x in pair))
    return number.cast("double") * F.element_at(length, F.lower(unit))


@dataclass(frozen=True)
class Wording:
    """A pattern whose matches are wrong where the parts say so."""

    rule: str
    pattern: str
    wrong: Callable[[Callable[[int], Column]], Column]
    severity: str = "warning"


_FIGURE = r"[$€£]?([0-9][0-9,]*(?:\.[0-9]+)?)"
_value = lambda x: F.regexp_replace(x, ",", "").try_cast("double")

WORDINGS = (
    Wording("serial-range-reversed", r"\b([A-Z]{1,4})-?([0-9]{2,12}) ?(?:to|through|–|-) ?([A-Z]{1,4})-?([0-9]{2,12})\b", lambda p: (p(1) == p(3)) & (F.length(p(2)) == F.length(p(4))) & (p(4) < p(2))),
    Wording("revision-direction-mismatch", rf"\b(?:revised|raised|lowered|cut|adjusted) ?(up|upward|upwards|down|downward|downwards)? from {_FIGURE}[a-z%]*(?: [a-z]+)? to {_FIGURE}", lambda p: F.when(p(1).startswith("up"), _value(p(3)) < _value(p(2))).when(p(1).startswith("down"), _value(p(3)) > _value(p(2))).otherwise(False)),
    Wording("period-part-exceeds-whole", rf"\b([0-9]+)[ -]({_UNITS})s? (?:within|of|out of|during) (?:a|an|the|its|your) ([0-9]+)[ -]({_UNITS})s?\b", lambda p: _days(p(1), p(2)) > _days(p(3), p(4))),
    Wording("walk-time-distance-mismatch", r"\b([0-9]+)[ -]min(?:ute)?s?(?:'s?)? walk[^.\n0-9]{0,30}?\(?([0-9][0-9,]*) ?(?:m|metres|meters)\b", lambda p: _value(p(1)) < F.ceil(_value(p(2)) / 80)),
    Wording("annual-holidays-mismatch", r"(?s)(?:two days off (?:a|per|every|each) week|weekends off).{0,400}?\b([0-9]{2,3}) (?:annual )?(?:holidays|days off) (?:a|per) year", lambda p: p(1).cast("int") < 104),
    Wording("email-subject-length", r"(?m)^Subject:[ \t]*(.*)$", lambda p: (F.length(F.trim(p(1))) == 0) | (F.length(F.trim(p(1))) > 70)),
)


def wording_findings(docs: DataFrame, rules: tuple[Wording, ...] = WORDINGS) -> DataFrame:
    """doc_id, rule, severity, n (wrong matches) and quote (the first of them); null texts have none."""

    def searched(r: Wording) -> Column:
        every = F.regexp_extract_all("text", F.lit(f"({r.pattern})"), F.lit(1))
        wrong = F.filter(every, lambda x: r.wrong(lambda k: F.regexp_extract(x, r.pattern, k)))
        return F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), wrong.alias("wrong"))

    each = T.exploded(docs.where("text IS NOT NULL"), ["doc_id"], F.array(*map(searched, rules)), "f").where(F.size("f.wrong") > 0)
    return each.select("doc_id", "f.rule", "f.severity", F.size("f.wrong").cast("bigint").alias("n"), F.get("f.wrong", F.lit(0)).alias("quote"))


def attachment_missing(docs: DataFrame) -> DataFrame:
    """attachment-not-attached: letters with a subject that say something is attached but list no attachment."""
    letter = F.col("text").rlike(r"(?m)^Subject:") & F.col("text").rlike(r"(?i)\b(?:attached|attachment|enclosed) (?:is|are|please|find|the|you|to)\b|\bplease find (?:attached|enclosed)\b|\bI(?:'ve| have) attached\b")
    listed = F.col("text").rlike(r"(?im)^(?:attachments?|enclosures?|attached files?): *\S")
    return docs.where(letter & ~listed).select("doc_id", F.lit("attachment-not-attached").alias("rule"), F.lit("warning").alias("severity"), F.lit(1).cast("bigint").alias("n"), F.regexp_substr("text", F.lit(r"(?i)[^.\n]*\b(?:attached|attachment|enclosed)\b[^.\n]*")).alias("quote"))


def versions_out_of_order(docs: DataFrame) -> DataFrame:
    """version-order: headings of a change log whose versions go one way but for fewer steps than go the other.

    n counts the steps against the majority; a tie is silent, equal versions count for neither.
    """
    found = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6} \[?v?([0-9]+\.[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    place = lambda x: F.transform(F.split(x, r"\."), lambda d: F.lpad(d, 9, "0"))
    read = docs.where(F.contains("text", F.lit("#"))).select("doc_id", F.transform(found, lambda x: F.struct(F.array_join(place(x), ".").alias("key"), x.alias("version"))).alias("v")).where(F.size("v") > 2)
    key = lambda k: F.get("v", k)["key"]
    step = lambda k: (key(k) > key(k - 1)).cast("int") - (key(k) < key(k - 1)).cast("int")
    steps = read.select("doc_id", "v", F.transform(F.sequence(F.lit(1), F.greatest(F.size("v") - 1, F.lit(1))), step).alias("steps"))
    up, down = F.size(F.filter("steps", lambda x: x == 1)), F.size(F.filter("steps", lambda x: x == -1))
    against = F.when(up > down, -1).otherwise(1)
    counted = steps.withColumns({"n": F.least(up, down).cast("bigint"), "against": against}).where((F.col("n") > 0) & (up != down))
    first = F.get("v", F.array_position("steps", F.col("against")).cast("int"))["version"]
    return counted.select("doc_id", F.lit("version-order").alias("rule"), F.lit("warning").alias("severity"), "n", first.alias("quote"))


def findings(docs: DataFrame) -> DataFrame:
    """All rules of this module: doc_id, rule, severity, n and quote."""
    return figure_findings(docs).unionByName(wording_findings(docs)).unionByName(attachment_missing(docs)).unionByName(versions_out_of_order(docs))
