"""Queries read their texts once: where they are dealt, what is searched for, and results of the rewritten steps."""

from __future__ import annotations

from dataclasses import replace

from docaudit.operators import masking, mentions
from docaudit.plans.rules import PATTERNS, PHRASES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, rows, schema="doc_id bigint, lang string, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_places_come_of_matches_alone(spark, tmp_path):
    """Each line feed of a text was a row that was exchanged and sorted."""
    searches = (masking.Search("b", "info", r"b[\n\x02]*"), masking.Search("e", "info", "x*"))
    docs = stored(spark, tmp_path, [(1, "en", "ab\n\nb\x02c\x01b\nb"), (2, "en", "\nb\n" * 2), (3, "en", None), (4, "en", "")])
    found = masking.located(docs, searches, docs.text)
    # Texts are exchanged before they are cut; nothing is exchanged behind that.
    assert plan(found).count("Exchange") == 1 and plan(found).rindex("Generate") < plan(found).index("Exchange")
    assert sorted((r.doc_id, r.start, r.end, r.line, r.col, r.quote) for r in found.collect()) == [
        (1, 1, 4, 1, 2, "b\n\n"), (1, 4, 6, 3, 1, "b\x02"), (1, 8, 10, 3, 5, "b\n"), (1, 10, 11, 4, 1, "b"), (2, 1, 4, 2, 1, "b\n\n"), (2, 4, 6, 4, 1, "b\n"),
    ]


def test_phrases_are_looked_for_at_once(spark, tmp_path):
    """Each list of phrases was searched for in every text."""
    searches = masking.searches_of(PATTERNS, PHRASES)
    assert sum(bool(s.words) for s in searches) > 20 and sum(s.wide for s in searches) > 5
    phrases = [p for r in PHRASES for p in r.phrases]
    rows = [(k, "en", f"We {p.replace(' ', '  ')}, {p.upper()}\n{p}x in x{p} so") for k, p in enumerate(phrases)]
    rows += [(1000, "en", " ".join(phrases)), (1001, "de", phrases[0]), (1002, "ja", "ａ・い・う・え・お・か・き — é―, ｱ ​ aб \U0001f680"), (1003, "en", "in order toin order to\nin\norder\tto")]
    docs = stored(spark, tmp_path, rows)
    plain = tuple(replace(s, words=(), wide=False) for s in searches)
    got, want = (sorted(map(tuple, masking.located(docs, s).collect())) for s in (searches, plain))
    assert got == want and len({x[1] for x in got}) > 30


def test_mentions_come_of_one_reading(spark, tmp_path):
    """Each rule cut the texts into sentences by itself, and dates were cut six times."""
    text = "Signed on 2024-01-05 and 2023-02-30. 2 weeks later, on 2024-01-18, it ended. June 5 it is.\nCall 03-1234-5678, 03-1234-5687 or 03-1234-5687.\nOwner: Ann\nOwner: Bob\nPay ten (99999999999999999999) days. 2 days later, on May 1, 2023, no."
    docs = stored(spark, tmp_path, [(1, "en", text), (2, "en", None), (3, "en", ""), (4, "en", "A 2 cm\nLength: 5 mm\nlength: 5 cm\nLength: 5 cm\nLength: 5 mm")])
    found = mentions.findings(docs, tuple(r for r in mentions.RULES if r not in mentions.OVER_ALL))
    assert plan(found).count("Scan parquet") == 1 and plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    assert sorted((r.doc_id, r.rule, r.para, r.quote) for r in found.collect()) == [
        (1, "date-without-year", 1, "June 5"), (1, "fact-conflict", 4, "owner"), (1, "impossible-date", 1, "2023-02-30"), (1, "number-word-figure-mismatch", 5, "ten (99999999999999999999)"),
        (1, "phone-number-variant", 1, "0312345678 / 0312345687"), (1, "relative-date-mismatch", 1, "2024-01-18"), (4, "fact-conflict", 5, "length"), (4, "unit-mismatch", 2, "length"),
    ]


def test_atoms_make_each_rest_once(spark, tmp_path):
    """The rest that a reader leaves was made again by each later reader: 45 replacements and more."""
    text = '# See "a Section 2" on 2024-01-02 at 10:30\nFigure 3.1 `Table 4` https://x.org/1 [^n1] Ann Lee paid $1,000.50\n'
    found = mentions.atoms(stored(spark, tmp_path, [(1, "en", text), (2, "en", None), (3, "en", "")]))
    assert plan(found.select("doc_id", "kind")).count("regexp_replace(") <= 9
    assert [(r.kind, r.key) for r in found.orderBy("nth").collect()] == [
        ("url", "https://x.org/1"), ("code", "`table 4`"), ("date", "2024-01-02"), ("time", "10:30"), ("quote", '"a section 2"'), ("footnote", "[^n1]"), ("reference", "figure 3.1"), ("heading", "# see ¤ on ¤ at ¤"), ("number", "$1000.50"), ("name", "ann lee"),
    ]
