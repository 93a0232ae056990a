"""The structure tree against a stack parser, and masked places against the raw text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docaudit.operators import masking, tree

WORDS = "payment notice term delivery party service fee audit record claim".split()


def contract(r):
    """A contract's lines, and for each unit (line, rank key, kind, number, absolute, depth of heading)."""
    out, section, styles = [], [0] * 6, None
    say = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(2, 6)))
    while len(out) < r.randint(20, 70):
        what = r.choice(("part", "chapter", "article", "dotted", "heading", "numbered heading", "items", "items", "text", "blank", "code"))
        if what == "part":
            out.append((f"PART {r.choice(('I', 'II', 'IV', '3'))} {say().title()}", "chapter"))
        elif what == "chapter":
            out.append((f"CHAPTER {r.randint(1, 9)}. {say().title()}", "chapter"))
        elif what == "article":
            out.append((f"ARTICLE {r.choice(('1', '12', 'IX'))} {say().title()}", "article"))
        elif what == "dotted":
            number = ".".join(str(r.randint(1, 9)) for _ in range(r.randint(2, 4)))
            out.append((f"{r.choice(('', 'Section '))}{number} {say().title()}", "article"))
        elif what == "heading":
            out.append((f"{'#' * r.randint(1, 4)} {say().title()}", "section"))
        elif what == "numbered heading":
            out.append((f"{'#' * r.randint(1, 4)} {r.randint(1, 9)}. {say().title()}", "article"))
        elif what == "items":
            styles = r.sample(("letter", "number", "capital", "roman"), r.randint(1, 3))
            numbers = {"letter": "abcdefgh", "number": "123456", "capital": "ABCD", "roman": ("i", "ii", "iii", "iv")}
            for k in range(r.randint(1, 3)):
                for depth in range(r.randint(1, len(styles))):
                    own = numbers[styles[depth]]
                    out.append((f"{' ' * 2 * depth}({own[min(k, len(own) - 1)]}) {say()}", "item"))
        elif what == "code":
            out += [("```", None), ("PART I In code", None), ("(a) in code", None), ("```", None)]
        else:
            out.append((say() if what == "text" else "", None))
    return [line for line, _ in out]


def parsed(lines):
    """(line, parent, kind, address, last) by a stack, of the same numbering."""
    roman = {"I": 1, "II": 2, "III": 3, "IV": 4, "IX": 9}
    stack, found, counts, order, code = [], [], [0] * 6, {}, False
    written = [bool(x.strip()) for x in lines]
    for at, line in enumerate(lines, 1):
        if line.startswith("```"):
            code = not code
            written[at - 1] = False
            continue
        if code:
            written[at - 1] = False
            continue
        heading = re.match(r"(#+) (.*)", line)
        words = heading[2] if heading else line
        unit = None
        if m := re.match(r"(PART|CHAPTER) (\w+)", words):
            unit = (7 if m[1] == "PART" else 8, "chapter", f"{'pt' if m[1] == 'PART' else 'ch'}{roman.get(m[2], m[2])}", False)
        elif m := re.match(r"ARTICLE (\w+)", words):
            unit = (10, "article", str(roman.get(m[1], m[1])), True)
        elif m := re.match(r"(?:Section )?(\d+(?:\.\d+)*)\.? ", words):
            if heading or "." in m[1]:
                unit = (9 + len(m[1].split(".")), "article", m[1], True)
        if unit is None and heading:
            unit = (0, "section", None, True)
        if unit is not None:
            order = {}
        elif m := re.match(r"\s*\((\w+)\) ", line):
            raw = m[1]
            style = "number" if raw.isdigit() else "capital" if raw.isupper() else "roman" if set(raw) <= set("ivx") else "letter"
            unit = (16 + order.setdefault(style, len(order) + 1), "item", raw, False)
        if heading:
            depth = len(heading[1])
            counts[depth - 1] += 1
            counts[depth:] = [0] * (6 - depth)
            unit = (depth, *unit[1:])
        if unit is None:
            continue
        rank, kind, number, absolute = unit
        while stack and stack[-1]["rank"] >= rank:
            stack.pop()
        numbered = next((x for x in stack[::-1] if x["number"]), None)
        section = next((x for x in stack[::-1] if x["kind"] == "section"), None)
        if kind == "section":
            address = "h" + ".".join(map(str, counts[: len(heading[1])]))
        else:
            address = number if absolute else f"{numbered['address']}.{number}" if numbered else f"{section['address']}/{number}" if section else number
        node = {"rank": rank, "kind": kind, "number": number, "address": address, "line": at}
        found.append([at, stack[-1]["line"] if stack else 0, kind, address, rank])
        stack.append(node)
    ends = []
    for at, parent, kind, address, rank in found:
        until = next((x[0] for x in found if x[0] > at and x[4] <= rank), len(lines) + 1)
        ends.append((at, parent, kind, address, max(k for k in range(at, until) if written[k - 1])))
    return ends


def test_nodes_equal_a_stack_parser(spark):
    r = random.Random(8)
    texts = [contract(r) for _ in range(60)]
    docs = spark.createDataFrame([(k, "\r\n".join(x)) for k, x in enumerate(texts)] + [(97, None), (98, ""), (99, "plain text")], "doc_id int, text string")
    found: dict = {}
    for x in tree.nodes(docs).collect():
        found.setdefault(x.doc_id, []).append((x.line, x.parent, x.kind, x.address, x.last))
        assert "\n".join(texts[x.doc_id])[x.start :].startswith(texts[x.doc_id][x.line - 1])
    for k, lines in enumerate(texts):
        assert sorted(found.get(k, [])) == parsed(lines), "\n".join(lines)
    assert set(found) <= set(range(60))


def test_one_row_many_times(spark):
    text = "ARTICLE 1 Fees\n(a) one\n(i) deep\n(ii) deep\n(b) two"
    docs = spark.createDataFrame([(1, text)] * 3, "doc_id int, text string")
    found = tree.nodes(docs)
    assert found.count() == 15 and found.select("row").distinct().count() == 3
    assert [x.address for x in found.where("row = 0").orderBy("line").collect()] in ([], ["1", "1.a", "1.a.i", "1.a.ii", "1.b"])


@pytest.mark.parametrize("letters, addresses", [("g h i j", ["g", "h", "i", "j"]), ("h i ii", ["h", "i", "i.ii"]), ("a i ii iii b", ["a", "a.i", "a.ii", "a.iii", "b"]), ("a 1 A i ii B 2 b", ["a", "a.1", "a.1.A", "a.1.A.i", "a.1.A.ii", "a.1.B", "a.2", "b"])])
def test_letters_and_numerals(spark, letters, addresses):
    docs = spark.createDataFrame([(1, "\n".join(f"({x}) words" for x in letters.split()))], "doc_id int, text string")
    assert [x.address for x in tree.nodes(docs).orderBy("line").collect()] == addresses


def test_dangling_references(spark):
    text = "ARTICLE 1 Fees\n(a) see Section 2.1(b) and Article IV\n2.1 Terms\n(b) as in Section 2.1(a), Section 9 of the Companies Act and Articles 1"
    docs = spark.createDataFrame([(1, text), (2, "see Article 9"), (3, None), (4, text.replace("(b) as", "(a) as"))], "doc_id int, text string")
    found = sorted((x.doc_id, x.line, x.quote, x.target) for x in tree.dangling_references(docs).collect())
    assert found == [(1, 2, "Article IV", "4"), (1, 4, "Section 2.1(a)", "2.1.a"), (4, 2, "Article IV", "4"), (4, 2, "Section 2.1(b)", "2.1.b")]
    for x in tree.leaves(docs).collect():
        assert (text if x.doc_id == 1 else text.replace("(b) as", "(a) as") if x.doc_id == 4 else "see Article 9")[x.start : x.end] == x.quote


RAW = """---
title: MARK
---
# MARK heading
Some **MARK** and `MARK` at https://x.org/MARK end.
```python
MARK = 1
``` MARK goes on
```
after [MARK here](http://MARK.x) <b>MARK</b> ![MARK](MARK.png)
| MARK | 1 |
> MARK quoted
MARK title
==========
<!-- MARK
MARK -->
🙂 日本 MARK
~~~
MARK unclosed
"""


def test_masked_places_are_raw_places(spark):
    long = "```\n" + "code MARK\n" * 60_000 + "```\nMARK here"
    docs = spark.createDataFrame([(1, RAW, "en"), (2, None, "en"), (3, "", "en"), (4, long, "en"), (1, RAW, "en"), (5, "MARK", "de")], "doc_id int, text string, lang string")
    (masked,) = docs.where("doc_id = 1").limit(1).select(masking.prose(F.col("text")).alias("m")).collect()
    assert len(masked.m) == len(RAW) and [i for i, c in enumerate(masked.m) if c == "\n"] == [i for i, c in enumerate(RAW) if c == "\n"]
    found = masking.located(docs, (masking.Search("mark", "warning", "MARK"), masking.Search("end", "info", r"\bend\b", "en")))
    rows = sorted((x.doc_id, x.start, x.end, x.line, x.col, x.quote) for x in found.collect())
    own = [x for x in rows if x[0] == 1]
    assert [(x[3], x[5]) for x in own[::2]] == [(5, "MARK"), (5, "end"), (10, "MARK"), (10, "MARK"), (17, "MARK")] and own[::2] == own[1::2]
    for d, start, end, line, col, quote in rows:
        raw = RAW if d == 1 else long if d == 4 else "MARK"
        assert raw[start:end] == quote and line == raw.count("\n", 0, start) + 1 and col == start - (raw.rfind("\n", 0, start) + 1) + 1
    assert [x[:4] for x in rows if x[0] == 4] == [(4, len(long) - 9, len(long) - 5, 60_003)] and [x[0] for x in rows].count(5) == 1


def test_places_of_random_texts(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(("ab", "b", "\n", " ", "é", "🙂", "aab")) for _ in range(r.randint(0, 40))) for _ in range(80)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    searches = {"a+b": "x", "b": "y", "🙂": "z", "\n ": "feed"}
    found = masking.located(docs, tuple(masking.Search(rule, "info", p) for p, rule in searches.items()), F.col("text"))
    rows = sorted((x.doc_id, x.rule, x.start, x.end, x.line, x.col) for x in found.collect())
    assert rows == sorted((k, rule, m.start(), m.end(), t.count("\n", 0, m.start()) + 1, m.start() - t.rfind("\n", 0, m.start())) for k, t in enumerate(texts) for p, rule in searches.items() for m in re.finditer(p, t))
    again = masking.ordered(found, ("y", "x")).collect()
    assert [(x.doc_id, x.line, x.col) for x in again] == sorted((x.doc_id, x.line, x.col) for x in again)
