"""Joins of points and intervals against nested loops, and comments that let findings stand."""

import random

import pytest

from docaudit.operators import ranges, stet


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(3)
    keys = ["a", "b", None]
    intervals = []
    for k in range(10_000):
        first = r.randint(-5_000, 100_000)
        intervals.append((r.choice(keys), k, first, first + r.choice((-1, 0, 1, 3, 4, 5, 16, 17, 64, 900, 20_000)) + r.randint(0, 3)))
    points = [(r.choice(keys), k, r.choice((None, r.randint(-6_000, 130_000)))) for k in range(60)]
    points += points[:3]
    return (
        points,
        intervals,
        spark.createDataFrame(points, "key string, p int, at int"),
        spark.createDataFrame(intervals, "key string, i int, first int, last int"),
    )


def test_within_equals_a_nested_loop(sides):
    points, intervals, a, b = sides
    found = ranges.within(a, b, ["key"], "at", "first", "last")
    held = sorted((p, i) for key, p, at in points if at is not None for own, i, first, last in intervals if own == key and first <= at <= last)
    assert sorted((r.p, r.i) for r in found.select("p", "i").collect()) == held and len(held) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_semi_and_anti_keep_every_row(sides):
    points, intervals, a, b = sides
    few = b.where("i < 60")
    hit = [p for key, p, at in points if at is not None and any(own == key and first <= at <= last for own, i, first, last in intervals[:60])]
    assert sorted(r.p for r in ranges.within(a, few, ["key"], "at", "first", "last", "left_semi").collect()) == sorted(hit)
    missed = sorted(p for p in [p for _, p, _ in points])
    for p in hit:
        missed.remove(p)
    assert sorted(r.p for r in ranges.within(a, few, ["key"], "at", "first", "last", "left_anti").collect()) == missed
    assert ranges.within(a, b.limit(0), ["key"], "at", "first", "last").count() == 0
    assert ranges.within(a, b.limit(0), ["key"], "at", "first", "last", "left_anti").count() == len(points)


def test_overlaps_equal_a_nested_loop(spark):
    r = random.Random(5)
    make = lambda n: [(k, x, x + r.choice((-2, 0, 1, 7, 250))) for k in range(n) for x in (r.randint(0, 800),)]
    left, right = make(150), make(150)
    a, b = spark.createDataFrame(left, "l int, l1 int, l2 int"), spark.createDataFrame(right, "r int, r1 int, r2 int")
    found = ranges.overlapping(a, b, [], "l1", "l2", "r1", "r2")
    assert sorted((x.l, x.r) for x in found.collect()) == sorted((i, j) for i, a1, a2 in left for j, b1, b2 in right if a1 <= a2 and b1 <= b2 and a1 <= b2 and b1 <= a2)


TEXT = """<!-- stet-file: whole-rule — agreed -->
# One
first line
<!-- stet: rule-a, rule-b — quoted from the brief -->
second line
still second

third
<!-- stet-section: rule-a -->
- item

- item after a blank
# Two
fourth <!-- stet: rule-b --> of five
fifth

<!-- stet: rule-a —
over two lines -->
| a | b |
|---|---|
| 1 | 2 |

last
"""


def test_scopes(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no comment")], "doc_id int, text string")
    found = {(r.rule, r.scope, r.line): (r.first, r.last, r.reason) for r in stet.scopes(docs).collect()}
    assert found == {
        ("whole-rule", "file", 1): (0, stet.END, "agreed"),
        ("rule-a", "next", 4): (4, 6, "quoted from the brief"),
        ("rule-b", "next", 4): (4, 6, "quoted from the brief"),
        ("rule-a", "section", 9): (9, 13, None),
        ("rule-b", "next", 14): (14, 15, None),
        ("rule-a", "next", 17): (17, 21, "over two lines"),
    }
    assert sorted(r.line for r in stet.without_reason(docs).collect()) == [9, 14]


def test_findings_that_stand(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "plain")], "doc_id int, text string")
    rows = [(d, rule, line, k) for k, (d, rule, line) in enumerate((d, rule, line) for d in (1, 2) for rule in ("rule-a", "rule-b", "whole-rule") for line in (3, 5, 8, 10, 13, 15, 21, 23))]
    found = spark.createDataFrame([*rows, (1, "whole-rule", None, 99)], "doc_id int, rule string, line int, k int")
    gone = {(1, "rule-a", x) for x in (5, 10, 13, 21)} | {(1, "rule-b", x) for x in (5, 15)} | {(1, "whole-rule", x) for x in (3, 5, 8, 10, 13, 15, 21, 23)} | {(1, "whole-rule", None)}
    assert {(r.doc_id, r.rule, r.line) for r in stet.suppressed(found, docs).collect()} == gone
    assert {r.k for r in stet.kept(found, docs).collect()} == {k for d, rule, line, k in rows if (d, rule, line) not in gone}
