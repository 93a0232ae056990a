"""What lets queries grow with their input: how often lines are exchanged, cut and joined, and results of the rewritten steps."""

from __future__ import annotations

import pyarrow

from docaudit.operators import runs, signatures, stet, tree
from docaudit.sources import html_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, rows, schema="doc_id bigint, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_periods_are_met_without_a_join(spark, tmp_path):
    one = "Period: 2024-01-01 to 2024-01-31\nterm: 2024-03-31 to 2024-03-01\nTerm: 2024-02-10 to 2024-02-20\n- Dates covered: 5 May 2024 until 7 May 2024\n"
    days = ("2024-01-01", "2024-01-31", "2024-02-01", "2024-02-20", "2024-03-15", "6 May 2024", "8 May 2024", "2024-01")
    text = one + "".join(f"- {d}\n" for d in days) + "2023-01-01\n"
    docs = stored(spark, tmp_path, [(1, text), (2, "- 2024-01-01\n"), (3, None), (4, "Period: 2024-03-31 to 2024-03-01\n| a |\n|---|\n| 2024-03-15 |\n")])
    found = runs.dates_outside_period(docs)
    # One exchange, of the texts.
    assert "Join" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    assert sorted((r.doc_id, r.quote) for r in found.collect()) == [(1, "2024-02-01"), (1, "2024-03-15"), (1, "8 May 2024"), (4, "2024-03-15")]


def test_trees_come_of_one_exchange_and_one_reading(spark, tmp_path):
    text = "PART 1 Supply\n# One\n### Deep\n## Two\nARTICLE 1 Items\n(a) goods, see Section 2.1, Section 1(b) and Section 7 of the Trade Act\n(i) more, see Section 1(a)(i)\n\n2.1 Terms\n# Three\n"
    docs = stored(spark, tmp_path, [(1, text), (2, "see Section 3"), (3, ""), (4, None), (5, "2.1 Terms, Section 2.1\n2.2 See Section 2.1 and Section 9")])
    found, asked = tree.nodes(docs), tree.dangling_references(docs)
    for df in (found, asked):
        assert plan(df).count("Exchange hashpartitioning") == 1 and plan(df).count("Scan parquet") == 1
    nodes = sorted((r.doc_id, r.line, r.parent, r.address, r.last) for r in found.collect())
    assert nodes == [
        (1, 1, 0, "pt1", 1), (1, 2, 0, "h1", 9), (1, 3, 2, "h1.0.1", 3), (1, 4, 2, "h1.1", 9), (1, 5, 4, "1", 9), (1, 6, 5, "1.a", 7), (1, 7, 6, "1.a.i", 7), (1, 9, 5, "2.1", 9), (1, 10, 0, "h2", 10),
        (5, 1, 0, "2.1", 1), (5, 2, 0, "2.2", 2),
    ]
    assert sorted((r.doc_id, r.line, r.quote, r.target) for r in asked.collect()) == [(1, 6, "Section 1(b)", "1.b"), (5, 2, "Section 9", "9")]


def test_plain_pages_are_cut_as_the_parser_reads_them():
    def parsed(page):
        reader = html_tables._Reader()
        reader.feed(page)
        reader.close()
        return [(t.cells, t.row) for t in reader.tables], [len(reader.stack), reader.skip]

    plain = [
        "<table><tr><td>a &amp; b<td rowspan=2 ROWSPAN='3' colspan>c</td></table>", "x<TABLE class=\"a b\"><TR><TH>1 > 0<p>2</TH ><td>&lt;b&gt; &nbsp &#x41</table", "<table>\n<tr><td\n colspan=\"2\">u<table><td>v</table>w<tr><td rowspan=>z",
        "<table><td>a<br/>b<!-- <td> --><td>c", "<table><td><script>'<td>'</script>d<td>e</table>", "<table><tr><td>1 < 2<td>3</tr></table>", "<table><td title=\"a&quot;b\" rowspan=02>q", "<title><table><td>x</title><table><td>y", "<p>no", "",
    ]
    for page in plain:
        reader = html_tables._read(page)
        assert ([(t.cells, t.row) for t in reader.tables], [len(reader.stack), reader.skip]) == parsed(page), page


def test_grids_leave_a_task_many_rows_at_once(spark, monkeypatch):
    """Batches used to be one a page."""
    made = []
    own = html_tables.pa.RecordBatch

    class Counting:
        @staticmethod
        def from_arrays(arrays, names):
            made.append(len(arrays[0]))
            return own.from_arrays(arrays, names=names)

    class Arrow:
        RecordBatch = Counting

        def __getattr__(self, name):
            return getattr(pyarrow, name)

    monkeypatch.setattr(html_tables, "pa", Arrow())
    batch = own.from_pydict({"page_id": pyarrow.array(range(50)), "html": ["<table><tr><td>a<td>b</table>"] * 49 + [None]})
    pages = spark.createDataFrame([(1, "x")], "page_id bigint, html string")
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema: list(f(iter([batch]))), raising=False)
    found = html_tables.table_grid(pages)
    assert made == [98] and found[0].column("page_id").to_pylist()[-1] == 48


def test_comments_are_read_once_and_met_without_a_join(spark, tmp_path):
    text = "<!-- stet: a — why -->\none\ntwo\n\n<!-- stet-section: b -->\nthree\n# Next\nfour\n<!-- stet-file: c -->\n"
    docs = stored(spark, tmp_path, [(1, text), (2, "plain"), (3, None)])
    found = spark.createDataFrame([(1, "a", 2, 7), (1, "a", 6, 8), (1, "a", 6, 8), (1, "b", 6, 1), (1, "b", 8, 2), (1, "c", None, 3), (2, "a", 2, 4), (None, "a", 2, 5)], "doc_id bigint, rule string, line int, first int")
    left = stet.kept(found, docs)
    assert left.columns == found.columns and "Join" not in plan(left) and plan(left).count("Scan parquet") == 1
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "a", 6, 8), (1, "a", 6, 8), (1, "b", 8, 2), (2, "a", 2, 4), (None, "a", 2, 5)], key=str)


def test_parameters_meet_their_tables_in_one_reading(spark, tmp_path):
    code = "```ts\nfunction f(a: Map<x, y> = (1, 2), {b}, c = d => d, e) {\n```\n"
    table = "| Argument | Kind |\n|---|---|\n| `a` | x |\n| g | x |\n| g | y |\n"
    fits = code.replace("{b}", "b")
    rows = [(1, fits + table), (2, code + table), (3, fits + "# Next\n" + table), (4, fits + fits + table + "end\n" + table), (5, table), (6, None), (7, fits.replace("```", "~~~") + "text\n" + table)]
    found = signatures.parameter_mismatches(stored(spark, tmp_path, rows))
    assert "Join" not in plan(found) and "Union" not in plan(found) and plan(found).count("Scan parquet") == 1
    apart = [("b", "signature"), ("c", "signature"), ("e", "signature"), ("g", "table")]
    want = [(1, 4, "f", *x) for x in apart] + [(4, 7, "f", *x) for x in apart] + [(7, 5, "f", *x) for x in apart]
    assert sorted(map(tuple, found.collect())) == want
    assert signatures.mark("a, [b, c], d => e, f) -> g, h") == "a\x01 [b, c]\x01 d => e\x01 f\x02 -> g, h"


def test_figures_are_made_of_the_labels_there_are(spark, tmp_path):
    """There was a column for each label of all rules, more code than the JVM compiles."""
    from docaudit.operators import arithmetic

    text = "Budget: 100\nActual: 160.5\nVariance: 50\n\nCapacity: 5\n\nRegistered: 6 people\n| Gross  weight | 7 |\nnet weight (: 9\nRent"
    docs = stored(spark, tmp_path, [(1, text), (2, None), (3, ""), (4, "Budget: 1\r\nActual: 2\r\nVariance: 3\r\nVariance: 1\r\nBudget: 1\r\nActual: 2")])
    assert {"stated", "said"} <= set(arithmetic.figures(docs).columns) and len(arithmetic.figures(docs).columns) < 8
    found = sorted((r.doc_id, r.rule, r.quote) for r in arithmetic.figure_findings(docs).collect())
    assert found == [(1, "count-over-capacity", "registered 6.00 against 5.00"), (1, "variance-mismatch", "variance 50.00 against 60.50"), (4, "variance-mismatch", "variance 3.00 against 1.00")]


def test_statements_of_figures_meet_without_exchange(spark, tmp_path):
    """What two statements say alike was made one by an exchange of all findings; statements were made one by one."""
    from docaudit.operators import arithmetic

    several = "Deposits: 10\nOpening balance: 100\nDeposits: 20\nWithdrawals: 5\nClosing balance: 12\n \t\n\nCapacity: 5\nRegistered: 6\nRegistered: 7\nRegistered: 6\n"
    rows = [(1, several), (1, several), (2, None), (3, ""), (4, "Budget: 1"), (5, "Capacity: €5.0\n\nRegistered: +1" + "0" * 400), (None, "Capacity: 1\nRegistered: 2")]
    found = arithmetic.figure_findings(stored(spark, tmp_path, rows))
    assert "Exchange" not in plan(found)
    got = sorted(((r.doc_id or 0, r.rule, r.quote) for r in found.collect()))
    once = [(1, "closing-balance-mismatch", "closing 12.00 against 125.00"), *((1, "count-over-capacity", f"registered {k}.00 against 5.00") for k in (6, 7))]
    assert got == [(0, "count-over-capacity", "registered 2.00 against 1.00"), *sorted(2 * once), (5, "count-over-capacity", "registered Infinity against 5.00")]


def test_shapes_come_of_one_reading(spark, tmp_path):
    """Texts were exchanged three times: for sections, for lists and for labels."""
    from docaudit.operators import shape

    text = "# T\n- a\n- b\n- c\n\n- **One**: x\n  - d\n  - e\n  - f\n- **Two**: y\n## Pros\nwords\n1. x\n2. y\n3. z\n4. w\n\n**Cons**: more\n"
    found = shape.measures(stored(spark, tmp_path, [(1, text), (2, "- a\n- b\n- c"), (3, None), (4, "")]))
    assert plan(found).count("Scan parquet") == 1 and "Join" not in plan(found)
    # Lists of 3, 2, 3 and 4 items.
    assert {r.doc_id: (r["three-item-lists"], r["bold-labels"]) for r in found.collect()} == {1: (50.0, 2.0), 2: (None, 0.0), 4: (None, 0.0)}


def test_texts_of_ascii_alone_are_not_sent_to_python_and_quotations_share_their_beginnings(spark, tmp_path):
    from docaudit.functions import text as T
    from docaudit.operators import mentions

    rows = [(1, "The same words begin here, and go on."), (2, "ＡＢ Ｃ é the same words begin there"), (3, None)]
    docs = stored(spark, tmp_path, rows)
    folded = docs.select("doc_id", T.folded(docs.text).alias("t"))
    (udf,) = [x for x in plan(folded).split("\n") if "ArrowEvalPython" in x]
    assert "_folded(CASE WHEN" in udf or "_folded(pythonUDF" not in udf and "_folded(text" not in udf
    assert {r.doc_id: r.t for r in folded.collect()} == {1: "thesamewordsbeginhere,andgoon.", 2: "abcéthesamewordsbeginthere", 3: None}
    keys = ["thesamewordsbeginhere", "thesamewordsbeginthere", "thesamewordsbeginnowhere", "thesamewordsbegin", "the", "é", "goon.", "goon.x", "bcé"]
    found = mentions._searched(docs.where("text IS NOT NULL").select("text"), keys)
    assert sorted({r.key for r in found.collect()}) == sorted(set(keys) - {"thesamewordsbeginnowhere", "goon.x"})
