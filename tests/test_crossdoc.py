"""Links and definitions over files, and HTML tables as grids."""

import random

from pyspark.sql import functions as F

from docaudit.operators import crossdoc
from docaudit.sources import html_tables

FILES = {
    "docs/a.md": "# Start\n[b](b.md) [b2](./b.md#fees) [no](b.md#costs) [gone](gone.md) [up](../README.md) [dir](sub/) [sub](sub) [x](https://x.org/q.md)\n`[code](nope.md)`\n```\n[fence](nope.md)\n```",
    "docs/b.md": "# Fees\n# Fees\n[same](#fees) [second](a.md#start) [third](b.md#fees-1) [fourth](b.md#fees-2) [img](p.png) [out](/abs.md) [enc](c%20d.md)",
    "docs/c d.md": "<a id='Own'></a> [own](c%20d.md#own) [twice](./../docs//a.md) [far](../other/x.md)",
    "docs/sub/index.md": "[page](page) [none](nopage) ![pic](none.md)",
    "docs/sub/page.mdx": "text",
    "README.md": "[a](docs/a) [docs](docs) [lost](docs/lost.markdown) [q](docs/a.md?x=1#start)",
    "empty.md": None,
}


def test_links_between_files(spark):
    docs = spark.createDataFrame(list(FILES.items()), "path string, text string")
    found = sorted((r.path, r.text, r.variant) for r in crossdoc.broken_links(docs).collect())
    assert found == sorted([
        ("docs/a.md", "no", "anchor"), ("docs/a.md", "gone", "file"), ("docs/b.md", "fourth", "anchor"), ("docs/sub/index.md", "none", "file"), ("README.md", "lost", "file"),
    ])
    assert crossdoc.broken_links(docs.limit(0)).count() == 0


def test_paths(spark):
    cases = {"a/./b//c": "a/b/c", "../a/../../b": "../../b", "a/..": "", "./x.md": "x.md", "a/b/../../../c": "../c"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", crossdoc.normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == cases


def test_definitions_out_of_step(spark):
    texts = {
        "1.md": '"Fee" means the price.\n"Term" means one year.',
        "2.md": '"Fee" means  the price.\n"Term" means two years.\n"Fee" means something else.',
        "3.md": '"Fee" shall mean the cost.\n```\n"Term" means in code.\n```',
        "4.md": '"Term" means two years.\n"Fee" means the\tprice.',
        "5.md": '"Term" means one year; and "Part" means a piece.',
        "6.md": None,
    }
    docs = spark.createDataFrame(list(texts.items()), "path string, text string")
    found = sorted(tuple(r) for r in crossdoc.definitions_out_of_step(docs).select("path", "line", "term", "files", "example").collect())
    assert found == [("2.md", 2, "Term", 4, "1.md"), ("3.md", 1, "Fee", 4, "1.md"), ("4.md", 1, "Term", 4, "1.md")]


def occupancy(rows):
    """The plain way: a matrix that each cell claims from its first free place on."""
    taken, height = {}, len(rows)
    for r, cells in enumerate(rows):
        c = 0
        for down, right, text in cells:
            while any((r, c) == p for p in taken):
                c += 1
            for i in range(r, min(r + down, height)):
                for j in range(c, c + right):
                    taken.setdefault((i, j), text)
            c += right
    width = max((c for _, c in taken), default=-1) + 1
    return [(r, c, taken.get((r, c), "")) for r in range(height) for c in range(width)]


def test_grids_equal_an_occupancy_matrix():
    r = random.Random(12)
    for _ in range(300):
        rows = [[(r.choice((1, 1, 2, 3)), r.choice((1, 1, 2)), f"t{r.randint(0, 99)}") for _ in range(r.randint(0, 4))] for _ in range(r.randint(1, 5))]
        closed = r.random() < 0.5
        page = "<table>" + "".join("<tr>" + "".join(f'<td rowspan={d} colspan="{w}">{t}' + "</td>" * closed for d, w, t in cells) + "</tr>" * closed for cells in rows) + "</table>"
        assert [(x[1], x[2], x[5]) for x in html_tables.grid(page)] == occupancy(rows)


def test_nested_and_odd_tables(spark):
    page = "<table><tr><th>A &amp; b<td>x <table><tr><td>in<script>no</script></table> y<tr><td rowspan=0>z</table>"
    rows = [(1, page), (2, None), (3, ""), (4, "<p>none"), (5, "<table><tr><td colspan=x>a<br>b"), (1, page), (None, "<table><td>c</table>")]
    found = html_tables.table_grid(spark.createDataFrame(rows, "page_id bigint, html string")).collect()
    own = sorted((r.tbl, r.row, r.col, r.header, r.text) for r in found if r.page_id == 1)
    assert own[::2] == [(0, 0, 0, True, "A & b"), (0, 0, 1, False, "x y"), (0, 1, 0, False, "z"), (0, 1, 1, False, ""), (1, 0, 0, False, "in")] and own[::2] == own[1::2]
    assert [(r.page_id, r.text) for r in found if r.page_id != 1] == [(5, "a b"), (None, "c")]
