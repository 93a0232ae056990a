"""The eleven measures, worked out by hand."""

from docaudit.operators import shape

ONE = """# Guide 🚀
Intro words here.

## Introduction
one two three four

## 1. How to start
a b c d

### Pros
x y
### Cons
x y
### Both
x y

## Why it works
a b

- **Speed**: fast
- **Cost**: low
- plain

text

1. a
2. b
3. c

text

* a
* b

## What is next
""" + "word " * 200 + """

p2

p3

## Conclusion
one two three four five
"""


def test_measures(spark):
    docs = spark.createDataFrame([(1, ONE), (2, None), (3, ""), (4, "plain words"), (1, ONE)], "doc_id int, text string")
    found = sorted((r.asDict() for r in shape.measures(docs).collect()), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in found] == [1, 1, 3, 4]
    words = 3 + 4 + 4 + 2 + 2 + 2 + 2 + 2 + 2 + 1 + 1 + 3 + 1 + 2 + 202 + 5
    own = found[0]
    assert own["heading-density"] == round(8 * 1000 / (words), 1)
    assert own["short-sections"] == round(6 * 100 / 8) and own["three-subsections"] == 1 and own["bookends"] == 2
    assert own["heading-forms"] == 50 and own["closing-restatement"] == 75 and own["three-item-lists"] == 67
    assert own["bold-labels"] == 2 and own["emoji-headings"] == 1 and own["pro-con"] == 1 and own["section-uniformity"] > 100
    assert {k: v for k, v in found[1].items() if k != "row"} == {k: v for k, v in own.items() if k != "row"}
    assert all(found[3][m] is None for m in ("heading-density", "short-sections", "section-uniformity", "heading-forms", "bookends", "closing-restatement", "three-item-lists", "pro-con"))
