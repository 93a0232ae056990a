"""HTML extraction with a site style tree.

The pages of one host are merged into a tree of style nodes: an element's path of tags, classes and ids. Each node has
the pages that show it, how differently its children are laid out over them (presentation) and how differently its text
reads (content), both as an entropy between 0 (the same everywhere) and 1 (never the same twice); copies of a page count
once. Branches of low importance are cut from each page, with those that tags, roles or class names mark as menus,
notices, adverts or comments; a name that only hints at one raises the importance that its branch needs. Noise inside a
block (a hidden word, a button) goes with its characters alone. A form goes if it is there to be filled in.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.session import checkpointed

#: A node is judged by entropy from so many pages on; below this importance its branch goes.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.25
#: The same for a branch whose name has a part that names what is no article text, beside others.
LEAST_IF_SUSPECT = 0.6
#: What presentation counts in a node's importance; content counts the rest.
PRESENTATION = 0.2
#: Low branches that are broadcast at most; beyond, pages are joined with them by host.
BROADCAST_BRANCHES = 200_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes|svg|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|type)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: A start tag ends an open element of these, up to the element that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_BOUNDS = frozenset("article aside blockquote body div footer header li main nav section table td th".split())
NOISE_TAGS = frozenset("aside button dialog fieldset footer head label menu nav noscript search select template".split())
CONTROLS = frozenset("button input select textarea".split())
#: A form with fewer words than this for each control, but hidden ones, is to be filled in, not read.
WORDS_A_CONTROL = 25
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Parts of class names and ids, cut at marks and capitals, that name what is no article text, and parts that say
#: nothing. A name of such parts alone is noise.
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising alert announcement banner bio breadcrumb breadcrumbs captcha comment commentary comments consent cookie cookies "
    "disclaimer discussion disqus feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted "
    "promotion rail recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar widget widgets".split()
)
NEUTRAL_NAMES = frozenset(
    "site page main top bottom left right center upper lower box block bar slot list wrap wrapper container section area item items inner outer content unit units post posts article entry "
    "link links button buttons icon icons global primary secondary header head body row col column panel group holder module media text title policy overlay dialog user reader us me the a s".split()
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CONTENT = frozenset(("article", "main"))
#: What head may hold; anything else ends it.
HEAD_CONTENT = frozenset("base link meta title style script template noscript".split())
#: Blocks of link text alone are menu entries in these, not in paragraphs and headings.
ENTRIES = frozenset("li td th div span dd dt ul ol tr".split())
_MASK = (1 << 64) - 1


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


@functools.lru_cache(1 << 16)
def _named(names: str) -> int:
    """2 if one of the class names and ids is noise, 1 if one has a part that is, 0 otherwise."""
    found = 0
    for name in names.split():
        parts = [x.lower() for x in _NAME.findall(name)]
        noise = sum(x in NOISE_NAMES for x in parts)
        if noise:
            found = max(found, 2 if all(x in NOISE_NAMES or x in NEUTRAL_NAMES for x in parts) else 1)
    return found


def _mix(a: int, b: int) -> int:
    a = ((a ^ b) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    return a ^ (a >> 29)


class _Node:
    __slots__ = ("tag", "path", "noise", "content", "form", "look", "text", "linked")

    def __init__(self, tag: str, path: int, noise: bool, content: bool, form: int = -1):
        self.tag, self.path, self.noise, self.content, self.form = tag, path, noise, content, form
        self.look, self.text = 0, 0


def parse(page: str, low: dict[int, float] | None = None) -> tuple[list[tuple[str, bool, bool, bool]], dict[int, tuple[int, int]]]:
    """Blocks (text, whether noise, whether in an article or main, whether a menu's entry) and, for each style path, its look and text as numbers.

    low: importance of the host's branches, as far as it is low.
    """
    low = low or {}
    root = _Node("", 0, False, False)
    stack, open_tags = [root], Counter()
    blocks: list[tuple[str, bool, bool, bool]] = []
    styles: dict[int, tuple[int, int]] = {}
    #: Runs of characters of the open block, each with whether it is noise.
    parts: list[tuple[str, bool]] = []
    #: For each form its controls and the words of its text; the form that is open, and the form of each block.
    forms: list[list[int]] = []
    homes: list[int] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(x for x, _ in parts).split())
        text = " ".join("".join(x for x, noise in parts if not noise).split())
        parts.clear()
        if whole:
            top = stack[-1]
            top.text = _mix(top.text, crc32(whole.encode("utf-8", "replace")))
            links_alone = linked >= len("".join(text.split())) and linked > 0
            noise = top.noise or not text
            blocks.append((text or whole, noise, top.content, links_alone and (top.tag in ENTRIES or top.tag == "a" and stack[-2].tag in ENTRIES)))
            homes.append(top.form)
            if top.form >= 0 and not noise:
                forms[top.form][1] += len(text.split())
        linked = 0

    def close() -> None:
        nonlocal links
        node = stack.pop()
        open_tags[node.tag] -= 1
        links -= node.tag == "a"
        stack[-1].text = _mix(stack[-1].text, node.text)
        look, text = styles.get(node.path, (0, 0))
        styles[node.path] = (_mix(look, node.look), _mix(text, node.text))

    def close_to(names, bounds) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in bounds:
                return

    def characters(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        if stack[-1].tag == "head" and not text.isspace():
            close_to(("head",), ())
        parts.append((text, stack[-1].noise))
        linked += len("".join(text.split())) if links and not stack[-1].noise else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            characters(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in ("br", "td", "th"):
            parts.append((" ", False))
        if m["end"]:
            if open_tags[tag] > 0:
                if tag in BLOCKS or tag in CONTENT:
                    flush()
                close_to((tag,), ())
            elif tag in BLOCKS:
                flush()
            continue
        if open_tags["head"] > 0 and tag not in HEAD_CONTENT and tag != "head":
            close_to(("head",), ())
        if tag in BLOCKS:
            flush()
            if open_tags["p"] > 0:
                close_to(("p",), _P_BOUNDS)
        if tag in CLOSES and any(open_tags[x] > 0 for x in CLOSES[tag][0]):
            close_to(*CLOSES[tag])
        attrs = {a.lower(): v.strip("\"'") for a, v in _ATTR.findall(m["attrs"])} if m["attrs"].strip(" /") else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        above = stack[-1]
        label = crc32(f"{tag} {names}".encode("utf-8", "replace"))
        above.look = _mix(above.look, label)
        if tag in CONTROLS and above.form >= 0 and attrs.get("type", "").lower() != "hidden":
            forms[above.form][0] += 1
        if tag in VOID:
            continue
        form = above.form
        if tag == "form" and form < 0:
            form = len(forms)
            forms.append([0, 0])
        path = _mix(above.path, label)
        content = above.content or tag in CONTENT or attrs.get("role") in ("main", "article")
        noise = above.noise or tag in NOISE_TAGS or (tag == "header" and not above.content and above.tag in ("", "html", "body")) or attrs.get("role", "").lower() in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        named = _named(names) if names else 0
        noise = noise or named == 2
        if not noise and "style" in attrs:
            noise = bool(_HIDDEN.search(attrs["style"]))
        if not noise and path in low and low[path] < (LEAST_IF_SUSPECT if named else LEAST_IMPORTANCE):
            # A word that every page has in its sentences is no branch.
            noise = tag in BLOCKS and tag not in CONTENT and tag not in ("html", "body")
        stack.append(_Node(tag, path, noise, content and not noise, form))
        open_tags[tag] += 1
        links += tag == "a"
    if at < len(page):
        characters(page[at:])
    flush()
    while len(stack) > 1:
        close()
    # A form of controls is noise; one that holds the page's text is not.
    filled = [words < WORDS_A_CONTROL * max(1, controls) for controls, words in forms]
    return [(text, noise or home >= 0 and filled[home], content, entry) for (text, noise, content, entry), home in zip(blocks, homes)], styles


def main_text(page: str, low: dict[int, float] | None = None) -> str:
    blocks, _ = parse(page, low)
    kept = [b for b in blocks if not b[1]]
    if low and not kept:
        # A host of equal pages: what is the same everywhere is all there is.
        kept = [b for b in parse(page)[0] if not b[1]]
    # Outside of articles, entries of link text alone are menus, unless there is nothing else.
    kept = [b for b in kept if b[2] or not b[3]] or kept
    return "\n".join(b[0] for b in kept)


def style_rows(pages: DataFrame) -> DataFrame:
    """host, page (a hash of the html), path, look and text of every style node of every page; pages without a host have none."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            hosts, rows = [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                if host and page:
                    digest = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                    own = [(digest, path, *style) for path, style in parse(page)[1].items()]
                    hosts += [host] * len(own)
                    rows += own
            numbers = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(numbers[:, k]) for k in range(4))], names=["host", "page", "path", "look", "content"])

    return pages.select("url", "html").mapInArrow(run, "host string, page bigint, path bigint, look bigint, content bigint")


def importance(pages: DataFrame) -> DataFrame:
    """host, path, pages and importance of every style node. Equal pages of a host count once.

    Both entropies are over the logarithm of the pages; a node on a single page has importance 1.
    """
    rows = style_rows(pages).dropDuplicates(["host", "page", "path"])
    kinds = rows.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("look").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("k"))
    counts = kinds.groupBy("host", "path", "k.kind", "k.value").agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    weighted = sums.withColumn("part", entropy * F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION))
    return weighted.groupBy("host", "path").agg(F.max("m").alias("pages"), F.sum("part").alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    return importance(pages).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IF_SUSPECT)).select("host", "path", "importance")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null or empty html gives the empty text; without a host a page is judged by its own marks alone; repeated pages
    are each answered. White space within a block is one space; br is white space, table rows are blocks.
    """
    low = checkpointed(low_branches(pages))
    few = low.limit(BROADCAST_BRANCHES + 1).count() <= BROADCAST_BRANCHES
    known: dict[str, dict[int, float]] = {}
    rows = pages.select("page_id", "url", "html")
    if few:
        for r in low.collect():
            known.setdefault(r.host, {})[r.path & _MASK] = r.importance
    else:
        lists = low.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("low"))
        rows = rows.withColumn("host", _host("url")).join(lists, "host", "left").select("page_id", "url", "html", "low")
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            texts = []
            for k, (url, page) in enumerate(zip(columns[0], columns[1])):
                own = shared.value.get(host_of(url)) if few else {x["path"] & _MASK: x["importance"] for x in columns[2][k] or ()}
                texts.append(main_text(page or "", own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
