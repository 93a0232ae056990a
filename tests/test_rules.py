"""Rules of the reference side with a text that fires and one that does not; expectations are written by hand."""

from __future__ import annotations

import pytest

from docaudit.operators import assay, findings, mentions, structure
from docaudit.plans.rules import FORMS, PATTERNS

#: rule: a text it must report, a text it must not.
PATTERN_TEXTS = {
    "doubled-punctuation": ("We met,, then left.", "We met, then left..."),
    "space-before-punctuation": ("It was late , so we left.", "It was late, so we left."),
    "missing-space-after-comma": ("red,green and blue", "red, green and 1,000"),
    "invisible-character": ("zero​width", "zero width"),
    "hankaku-kana": ("これはｶﾅです", "これはカナです"),
    "lookalike-character": ("pаypal", "paypal"),
    "all-caps-shouting": ("READ THIS NOTE NOW please", "Read THIS note NOW please"),
    "numeral-sentence-start": ("It rained. 12 people left.", "It rained. Twelve people left."),
    "calendar-name-case": ("See you on monday.", "See you on Monday."),
    "hyphen-as-dash": ("It was late - very late.", "It was well-known."),
    "latin-abbreviation-form": ("fruit, eg. apples", "fruit, e.g., apples or so"),
    "ordinal-suffix-mismatch": ("the 2st of May", "the 1st, 2nd, 3rd, 11th and 21st"),
    "article-sound": ("a apple", "an apple, a unit and an hour"),
    "unfilled-placeholder": ("Dear [Your name],", "Dear [1],"),
    "chat-citation-residue": ("see :contentReference[oaicite:0]", "see the reference"),
    "impossible-time": ("at 25:30 sharp", "at 23:30 sharp"),
    "share-over-hundred": ("120.5% of respondents said", "20.5% of respondents said"),
    "url-run-on": ("https://example.com/です", "https://example.com です"),
    "vague-figure-reference": ("as the table below shows", "as Table 2 shows"),
    "sentence-initial-so": ("It rained.\nSo, we left.\nSo, we slept.", "It rained, so we left."),
    "unrendered-emphasis": ("a ** bold ** word", "a **bold** word"),
    "no-nakaguro-parallel": ("赤・青・黄・白・黒・緑の色", "赤・青の色"),
    "max-kanji-continuous": ("東京都新宿区西新宿二丁目", "東京の新宿"),
    "max-ten": ("あ、い、う、え、お、か、き、く。", "あ、い、う。"),
    "connective-hierarchy": ("甲並びに乙。", "甲及び乙並びに丙。"),
    "repeated-exclamation": ("No!! Never!! Ever!!", "No! Never!"),
}
#: rule: a text with both forms, a text with one.
FORM_TEXTS = {
    "ellipsis-consistency": ("Well... so... and... then… end", "Well... so..."),
    "quote-style-consistency": ('He said "yes" and “no”.', 'He said "yes" and "no".'),
    "bracket-width-consistency": ("one (1) and （2）", "one (1) and (2)"),
    "date-format-consistency": ("2024-05-06 and 2024-05-07 and 2024-05-08 and May 6, 2024", "2024-05-06 and 2024-05-07"),
    "contraction-consistency": ("We don't go. We do not stay. We do not eat.", "We do not go."),
    "fullwidth-alnum-consistency": ("abc def ghi Ａ", "abc def"),
    "kutoten-consistency": ("一、二。三，四", "一、二。"),
    "number-style-consistency": ("1,000 and 2,000 and 3,000 and 4000", "1,000 and 2,000"),
    "currency-notation-consistency": ("$5 and $6 and $7 and USD 8", "$5 and $6"),
}
MENTION_TEXTS = {
    "impossible-date": ("due 2024-02-30 at noon", "due 2024-02-28 at noon"),
    "date-weekday-mismatch": ("on Monday, January 2, 2024 we met", "on Tuesday, January 2, 2024 we met"),
    "date-range-reversed": ("open 2024-05-10 to 2024-05-01", "open 2024-05-01 to 2024-05-10"),
    "amount-range-reversed": ("costs $90–$50 each", "costs $50–$90 each"),
    "time-range-reversed": ("open 17:00–09:00 daily", "open 09:00–17:00 daily"),
}


def one_each(spark, texts, lang=None):
    rows = [(2 * k + side, lang(t[side]) if lang else "en", t[side]) for k, t in enumerate(texts.values()) for side in (0, 1)]
    return spark.createDataFrame([*rows, (9000, "en", None), (9001, "en", "")], "doc_id bigint, lang string, text string")


def check(found, texts):
    for k, rule in enumerate(texts):
        assert rule in {r for d, r in found if d == 2 * k}, f"{rule} is silent"
        assert rule not in {r for d, r in found if d == 2 * k + 1}, f"{rule} fires"
    assert not [r for d, r in found if d >= 9000]


def test_patterns(spark):
    assert set(PATTERN_TEXTS) <= {p.rule for p in PATTERNS}
    check([(r.doc_id, r.rule) for r in findings.pattern_findings(one_each(spark, PATTERN_TEXTS)).collect()], PATTERN_TEXTS)


def test_forms(spark):
    assert set(FORM_TEXTS) <= {p.rule for p in FORMS}
    check([(r.doc_id, r.rule) for r in findings.form_findings(one_each(spark, FORM_TEXTS)).collect()], FORM_TEXTS)


def test_mentions(spark):
    assert set(MENTION_TEXTS) <= set(mentions.RULES)
    check([(r.doc_id, r.rule) for r in mentions.findings(one_each(spark, MENTION_TEXTS), tuple(MENTION_TEXTS)).collect()], MENTION_TEXTS)


def test_gated_patterns_find_what_ungated_ones_do(spark, monkeypatch):
    """What a pattern needs is only a shortcut."""
    texts = [t for pair in (*PATTERN_TEXTS.values(), *FORM_TEXTS.values()) for t in pair]
    docs = spark.createDataFrame([(k, "en", t + "\n" + texts[-k]) for k, t in enumerate(texts)], "doc_id bigint, lang string, text string")
    read = lambda: (set(findings.pattern_findings(docs).collect()), set(findings.form_findings(docs).collect()))
    gated = read()
    monkeypatch.setattr(findings, "NEEDS", {})
    assert read() == gated and len(gated[0]) > 30


@pytest.mark.parametrize("text, want", [("( [ ] )", None), ("( ]", "(]"), (")(", ")("), ("a (b [c) d]", "([)]"), ("「あ」と『い", "『"), ("none", None)])
def test_brackets_pair_by_family(spark, text, want):
    found = structure.unbalanced_brackets(spark.createDataFrame([(1, "en", text)], "doc_id bigint, lang string, text string")).collect()
    assert [r.marks for r in found] == ([] if want is None else [want])


def test_doubled_words(spark):
    docs = spark.createDataFrame([(1, "en", "It is is what it it, it is. The the end. one. One"), (2, "en", None), (3, "en", "")], "doc_id bigint, lang string, text string")
    assert sorted(r.word for r in structure.doubled_words(docs).collect()) == ["is", "the"]


def test_atoms_have_their_kind(spark):
    docs = spark.createDataFrame([(1, "See https://example.com on 2024-05-06 at 10:30, 1,000 units, Anna Schmidt.")], "doc_id bigint, text string")
    found = {(r.kind, r.key) for r in mentions.atoms(docs).collect()}
    assert {("url", "https://example.com"), ("date", "2024-05-06"), ("time", "10:30"), ("number", "1000"), ("name", "anna schmidt")} <= found


def test_cycles(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(12)]
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "d"), ("d", "e"), ("e", "d"), ("s", "s"), ("a", "b"), ("e", "c0"), *chain]
    found = {r.node for r in assay.in_cycles(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {"a", "b", "c", "d", "e"}
    assert assay.in_cycles(spark.createDataFrame(chain, "a string, b string")).count() == 0
    assert assay.in_cycles(spark.createDataFrame([], "a string, b string")).count() == 0


def test_phrases_by_place(spark):
    from docaudit.plans.rules import Phrases

    rules = tuple(Phrases(f"r-{place}", ("picture this",), (1, 1, 1), where=place) for place in ("any", "start", "opening", "closing"))
    texts = {
        1: "One. Two. Three. We picture this. Five.\nEnd of it.",
        2: "One. Two. Three. Four. Picture this now.\nEnd of it.",
        3: "One. Two. Three. Four. Five.\nThe end. We picture this!",
        4: "Picture this.",
        5: "Nothing here.",
        6: None,
    }
    docs = spark.createDataFrame([(k, "en", t) for k, t in texts.items()], "doc_id bigint, lang string, text string")
    found = {(r.doc_id, r.rule) for r in findings.phrase_findings(docs, rules).collect()}
    assert found == {(1, "r-any"), (1, "r-opening"), (2, "r-any"), (2, "r-start"), (3, "r-any"), (3, "r-closing"), *((4, r.rule) for r in rules)}
