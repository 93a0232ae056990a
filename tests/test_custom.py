"""A team's own rules: positions against plain matching, and what is refused."""

from __future__ import annotations

import re

import pytest

from docaudit.operators import custom, regex_safety

TEXT = "Intro 🙂 foo\nfoo bar Foo\n\n  the team MUST go, foobar\nwe must"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string")


@pytest.mark.parametrize("rule", [custom.Custom("own", r"f[o]{2}"), custom.internal_jargon(("foo", "foo bar")), custom.requirement_modal()])
def test_positions_equal_plain_matching(spark, rule):
    found = custom.custom_findings(docs(spark, [(1, "en", TEXT), (2, "en", None), (3, "en", ""), (1, "en", TEXT)]), (rule,)).collect()
    want = []
    for m in re.finditer(rule.pattern, TEXT):
        before = TEXT[: m.start()]
        want.append((1, m.start(), m.end(), before.count("\n") + 1, m.start() - before.rfind("\n"), m[0]))
    assert want and sorted((r.doc_id, r.start, r.end, r.line, r.col, r.quote) for r in found) == sorted(2 * want)


def test_preferred_terms_and_language(spark):
    rules = (*custom.preferred_terms({"log in": "sign in"}), custom.requirement_modal())
    found = custom.custom_findings(docs(spark, [(1, "en", "Please log  in, you must."), (2, "de", "must")]), rules).collect()
    assert {(r.doc_id, r.rule, r.message) for r in found} == {(1, "preferred-term", "write sign in"), (1, "requirement-modal", "write shall")}


def test_required_sections(spark):
    rows = [(1, "en", "# Scope\ntext\n## risks ##\n"), (2, "en", "Scope\n# Risks"), (3, "en", None), (4, "en", "")]
    found = {(r.doc_id, r.quote) for r in custom.required_sections(docs(spark, rows), ("Scope", "Risks")).collect()}
    assert found == {(2, "Scope"), (4, "Scope"), (4, "Risks")}


@pytest.mark.parametrize("pattern", ["(a+)+", "(a*)*b", "(", "a*", r"(a)\1", "(?:x+y?)+z", "(a{2,})+"])
def test_patterns_that_are_not_run(pattern):
    assert custom.unsafe(pattern)
    with pytest.raises(ValueError):
        custom.Custom("own", pattern)


@pytest.mark.parametrize("pattern", ["a+", "(?:ab)+", r"\(x\)+", "[a+]+b", "(a|b)c{2,3}"])
def test_patterns_that_are_run(pattern):
    assert custom.unsafe(pattern) is None


def test_comments_switch_rules_off(spark):
    text = "foo\n<!-- stet-next-line own -->\nfoo\nfoo\n<!-- stet -->\nfoo"
    table = docs(spark, [(1, "en", text), (2, "en", "foo\n<!-- stet other -->\nfoo")])
    found = custom.custom_findings(table, (custom.Custom("own", "foo"),))
    assert sorted((r.doc_id, r.line) for r in custom.unsuppressed(found, table).collect()) == [(1, 1), (1, 4), (2, 1), (2, 3)]


def ways(pattern, text):
    """In how many ways a backtracking matcher may read the text up to its end: by paths through the positions."""
    own = regex_safety.positions(pattern)
    counts = {k: 1 for k in own.first if ord(text[0]) in own.sets[k]}
    for c in text[1:]:
        following: dict = {}
        for k, n in counts.items():
            for q in own.follow[k]:
                if ord(c) in own.sets[q]:
                    following[q] = following.get(q, 0) + n
        counts = following
    return sum(counts.values())


@pytest.mark.parametrize("pattern", ["(a|aa)+b", "(a|b|ab)*c", "a*a*a*a*a*b", "(?:x|x)*y", r"(\w|\d)+!", "(a|b|[ab])+z", r"(?:\s|\n)*x", "x(?=(a|aa)*b)y", ".*a.*a.*a", "a{1,90}a{1,90}a{1,90}b", "(?:ab|a|b)+;"])
def test_patterns_with_too_many_ways_are_not_run(pattern):
    assert custom.unsafe(pattern) is not None


@pytest.mark.parametrize("pattern", [r"\bfoo\b", r"\s*\w+\s*;", r"(?:ab|cd)+e", r"[A-Z][a-z]+(?: [A-Z][a-z]){0,3}", r"\$[0-9]+(?:\.[0-9]{2})?", r"(?i)(?<![A-Za-z])(?:one|two\s+words)(?![a-z])", "a{2,3}b{1,2}", r"\p{L}+-\p{Lu}", ".*foo"])
def test_plain_patterns_are_run(pattern):
    assert custom.unsafe(pattern) is None


def test_the_verdict_follows_the_number_of_ways():
    assert ways("(a|aa)+", "a" * 24) > 10_000 and ways("a*a*a*", "a" * 40) > 500
    assert ways(r"(?:ab|cd)+", "abcd" * 10) == 1 and ways("[a-z]+", "a" * 40) == 1


def test_long_patterns_and_other_dialects(spark):
    assert custom.unsafe("a" * 600) == "is too long"
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id int, text string, lang string")
    with pytest.raises(ValueError):
        custom.custom_findings(docs, (custom.Custom("own", r"(?P<n>x)"),))
