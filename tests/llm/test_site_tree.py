"""HTML extraction over made-up sites."""

from __future__ import annotations

from docaudit.llm import queries, site_tree

from . import cases

PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p {{ color: red }}</style><script>var a = "<p>no</p>";</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title {k}</h1><p>First &amp; <b>bold</b>
  text {k}.</p><p>Second&nbsp;part<br>goes on {k}</p><div class="ad-slot">Buy now</div><ul><li>Item A{k}</li><li>Item B{k}</li></ul>
<form><label>Name</label><input></form></article>
<section id="comments"><p>A reader says</p></section><aside>Side</aside><footer>Imprint</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_article_alone_stays(spark):
    rows = [(k, f"https://site.example/{k}", PAGE.format(k=k)) for k in range(12)]
    found = {r.page_id: r for r in site_tree.extract(pages(spark, rows)).collect()}
    for k in range(12):
        assert found[k].text == f"Title {k}\nFirst & bold text {k}.\nSecond part goes on {k}\nItem A{k}\nItem B{k}"
        assert found[k].n_chars == len(found[k].text) and found[k].url == f"https://site.example/{k}"


def test_what_is_the_same_on_every_page_goes_without_marks(spark):
    shape = "<body><div class=u1><p>All rights belong to nobody here</p></div><div class=u2><p>Text of page {k} alone, word{k} other{k}</p></div></body>"
    rows = [(k, f"http://plain.example/{k}", shape.format(k=k)) for k in range(20)] + [(100, "http://single.example/", shape.format(k=0))]
    found = {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}
    assert all(found[k] == f"Text of page {k} alone, word{k} other{k}" for k in range(20))
    assert found[100].startswith("All rights")


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://h/", "plain &lt;text&gt; only"), (4, None, "<p>a<p>b<div>c"), (5, "http://h/", "<div"), (None, "http://h/", "<p>x</p>"), (6, "http://h/", "<p>" * 3000 + "deep"), (4, None, "<p>a<p>b<div>c")]
    found = site_tree.extract(pages(spark, rows)).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows)
    assert got[1] == got[2] == "" and got[3] == "plain <text> only" and got[4] == "a\nb\nc" and got[None] == "x" and got[6] == "deep"
    assert site_tree.extract(pages(spark, [])).count() == 0


def test_lists_of_branches_joined_by_host_give_the_same(spark, monkeypatch):
    rows = [(k, f"https://site{k % 2}.example/{k}", PAGE.format(k=k)) for k in range(24)]
    want = {tuple(r) for r in site_tree.extract(pages(spark, rows)).collect()}
    monkeypatch.setattr(site_tree, "BROADCAST_BRANCHES", 0)
    assert {tuple(r) for r in site_tree.extract(pages(spark, rows)).collect()} == want


def test_whole_table(spark):
    found = queries.op1_site_tree(spark, cases.DATA).collect()
    assert len(found) == spark.read.parquet(f"{cases.DATA}/pages.parquet").count()
    assert all(r.text and "<" not in r.text[:1] for r in found)


def texts_of(spark, shape, n=20, host="odd.example"):
    rows = [(k, f"http://{host}/{k}", shape.format(k=k)) for k in range(n)]
    return {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}


def test_head_may_end_unsaid(spark):
    for shape in ("<html><head><title>T</title><body><article><p>Hello {k}</p></article>", "<head><title>T</title><p>Hello {k}", "<html><head><meta charset=x><title>T</title>Hello {k}"):
        assert texts_of(spark, shape, 3)[1] == "Hello 1"


def test_names_that_only_hint_keep_their_text(spark):
    for name in ("social-history", "form-factor", "tags-guide"):
        found = texts_of(spark, f"<article><h1>Title {{k}}</h1><div class={name}><p>Own text {{k}} of {{k}}</p></div></article>")
        assert found[3] == "Title 3\nOwn text 3 of 3"
        # The tree decides: the same branch goes where it is nearly the same on every page.
        shape = f"<body><h1>Title {{k}}</h1><div class={name}><p>Always this</p></div><p>Own {{k}}</p></body>"
        assert texts_of(spark, shape)[3] == "Title 3\nOwn 3"
    for name in ("ad-slot", "cookie-notice", "commentList", "sidebar right"):
        assert texts_of(spark, f"<body><p>Own {{k}}</p><div class='{name}'><p>Own too {{k}}</p></div></body>")[3] == "Own 3"


def test_titles_and_intros_beside_articles_stay(spark):
    assert texts_of(spark, "<body><div class=post><header><h1>Title {k}</h1></header><p>Text {k} of it</p></div></body>", 3)[1] == "Title 1\nText 1 of it"
    shape = "<body><h1>Heading {k}</h1><p>Lead of {k}</p><article>" + "<p>Much more text than the lead has, about {k}</p>" * 5 + "</article></body>"
    assert texts_of(spark, shape, 3)[1] == "\n".join(["Heading 1", "Lead of 1"] + ["Much more text than the lead has, about 1"] * 5)
    shape = "<body><h1>Heading {k}</h1><p>A long introduction number {k} that goes on and on</p><article><p>Teaser {k}</p></article></body>"
    assert texts_of(spark, shape, 3)[1] == "Heading 1\nA long introduction number 1 that goes on and on\nTeaser 1"
    assert texts_of(spark, "<body><p>Text {k}</p><p><a href=x>A paragraph of link text {k}</a></p><ul><li><a href=y>Entry {k}</a></li></ul></body>", 3)[1] == "Text 1\nA paragraph of link text 1"


def test_copies_of_a_page_do_not_lower_its_importance(spark):
    shape = "<body><div class=k1><p>Footer of all</p></div><div class=k2><h1>Title {k}</h1><p>Text {k} and more {k}</p></div></body>"
    rows = [(k, f"http://copies.example/{k}", shape.format(k=max(0, k - 90))) for k in range(110)]
    found = {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}
    assert all(found[k] == f"Title {max(0, k - 90)}\nText {max(0, k - 90)} and more {max(0, k - 90)}" for k in range(110))


def test_the_tree_alone_finds_the_text_of_sites_with_opaque_names(spark):
    """Six hosts of 30 pages with generated class names, no article or main: text of each page against its text as written."""
    rows, want, off = [], {}, 0
    for h in range(6):
        for k in range(30):
            own = [f"Heading {h} {k}", *(f"Sentence {i} of page {k} says w{(k * 7 + i) % 31} x{(k * 3 + i) % 29}." for i in range(2 + k % 4))]
            page = f"<body><div class=a{h}x><span>Shop of {h}</span><p>Home Products About</p></div><div class=b{h}y><h2>{own[0]}</h2>" + "".join(f"<p>{x}</p>" for x in own[1:]) + f"</div><div class=c{h}z><div class=q{h}><p>Terms and legal text of host {h}</p></div></div></body>"
            rows.append((100 * h + k, f"https://h{h}.example/{k}", page))
            want[100 * h + k] = "\n".join(own)
            off += site_tree.main_text(page) != want[100 * h + k]
    found = {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}
    assert found == want and off == len(rows)


def test_noise_inside_blocks_goes_with_its_characters():
    for noise in ('<span style="display:none">HIDDEN</span>', "<b hidden>x</b>", '<span class="ad">BUY NOW</span>', "<button>SHARE</button>", "<noscript>js</noscript>", "<select><option>a<option>b</select>"):
        assert site_tree.main_text(f"<body><article><p>Hi {noise} there</p><p>{noise}</p></article></body>") == "Hi there"


def test_forms_to_be_filled_in_go_and_pages_inside_one_stay():
    text = "".join(f"<p>Paragraph {k} of the page has a number of words to read.</p>" for k in range(6))
    page = '<form id="aspnetForm"><input type=hidden name=state><input name=q><h1>Head</h1>' + text + "</form>"
    assert site_tree.main_text(page).split("\n")[::6] == ["Head", "Paragraph 5 of the page has a number of words to read."]
    assert site_tree.main_text(f"<body>{text}<form><p>Tell us your name</p><input><select><option>x</select></form></body>").count("\n") == 5
