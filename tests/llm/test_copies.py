"""SimHash links, line chunks and weighted samples against plain versions."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docaudit.llm import line_chunks, queries, simhash, weighted_sampling
from docaudit.llm.components import components

from . import cases


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def component_ids(prints: list[tuple[int | None, int]], bits: int = 3) -> list[tuple]:
    parent = list(range(len(prints)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(prints):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [(d, f"{f:016x}", least.get(root(k))) for k, (d, f) in enumerate(prints)]


def test_simhash_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op8_simhash(spark, cases.DATA).collect()]
    assert sorted(got) == sorted(component_ids([(d, fingerprint(t)) for d, t in rows]))


def test_simhash_of_odd_rows(spark):
    found = simhash.near_components(cases.documents(spark)).select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0"), "component_id")
    want = component_ids([(d, fingerprint(t)) for d, t in cases.ODD])
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert simhash.near_components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("group", [1, 3, simhash.GROUP])
def test_links_keep_every_component_however_groups_are_cut(spark, group):
    r = random.Random(group)
    prints = []
    for _ in range(25):
        base = r.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            prints.append(x)
            base = x if r.random() < 0.5 else base
    half = r.getrandbits(32) << 32
    prints += [half | r.getrandbits(6) for _ in range(60)] + [half >> 32 | r.getrandbits(6) << 40 for _ in range(60)]
    prints = sorted(set(prints))
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    table = spark.createDataFrame([(x, 0, x) for x in signed], "node bigint, t int, f bigint")
    roots = {n: root for n, root in components(simhash.links(table, ["node"], 3, group=group)).collect()}
    by_root: dict = {}
    for s, x in zip(signed, prints):
        by_root.setdefault(roots.get(s, s), set()).add(x)
    want: dict = {}
    for d, f, c in component_ids([(k, x) for k, x in enumerate(prints)]):
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_a_star_and_loops(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 300), (1, 0), (400, 401), (401, 400)]
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 150)), [400, 401]]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edited(words: list[str], r: random.Random, changes: int) -> str:
    out = list(words)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_of_the_pipeline(spark):
    """Copies with a few changed words meet, unlike texts and halves of each other do not."""
    r = random.Random(5)
    rows, groups = [], []
    for g in range(30):
        words = [f"t{r.randrange(4000)}" for _ in range(r.choice((120, 250, 600)))]
        rows.append((g * 10, " ".join(words)))
        rows.append((g * 10 + 1, edited(words, r, max(1, len(words) // 120))))
        rows.append((g * 10 + 2, " ".join(words[: len(words) // 2] + [f"u{r.randrange(4000)}" for _ in words[len(words) // 2 :]])))
        groups.append((g * 10, g * 10 + 1, g * 10 + 2))
    found = {x.doc_id: x.component_id for x in simhash.duplicates(cases.documents(spark, rows)).collect()}
    assert sum(found[a] == found[b] for a, b, _ in groups) >= 29
    assert all(found[c] == c for _, _, c in groups)


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def found_pairs(spark, pairs):
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    found = {x.doc_id: x.component_id for x in simhash.duplicates(cases.documents(spark, rows)).collect()}
    return [found[2 * k] == found[2 * k + 1] for k in range(len(pairs))]


def border_pairs(r: random.Random, low: float, high: float, each: int = 100) -> dict[str, list[tuple[str, str]]]:
    """Pairs with a similarity in [low, high), one text edited by words replaced, text appended or its end cut."""
    made: dict = {"replace": [], "append": [], "cut": []}
    while min(map(len, made.values())) < each:
        kind = r.choice([k for k in made if len(made[k]) < each])
        w = [f"t{r.randrange(5000)}" for _ in range(r.randint(80, 400))]
        if kind == "replace":
            other = edited(w, r, r.randint(1, len(w) // 15))
        elif kind == "append":
            other = " ".join(w + [f"u{r.randrange(5000)}" for _ in range(r.randint(1, len(w) // 2))])
        else:
            other = " ".join(w[: r.randint(len(w) // 2, len(w) - 1)])
        if low <= jaccard(" ".join(w), other) < high:
            made[kind].append((" ".join(w), other))
    return made


def test_near_copies_at_the_border_are_found_by_every_edit(spark):
    """At least 99 of 100 of each kind; brute force decides what is near."""
    for pairs in border_pairs(random.Random(11), 0.8, 0.84).values():
        assert sum(found_pairs(spark, pairs)) >= 99


def test_pairs_below_the_border_stay_apart(spark):
    """Brute force decides; most are close enough to be candidates."""
    pairs = sum(border_pairs(random.Random(12), 0.7, 0.8, each=40).values(), [])
    assert not any(found_pairs(spark, pairs))


def test_line_chunks_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{cases.DATA}/documents.parquet'")
    want = {tuple(map(lambda x: x if isinstance(x, str) or x is None else int(x), x)) for x in con.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({line_chunks.SQL})").fetchall()}
    assert {tuple(r) for r in queries.op7_line_chunks(spark, cases.DATA).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()} == want


def test_line_chunks_of_odd_rows(spark):
    found = line_chunks.deduplicated(cases.documents(spark))
    assert found.columns[:7] == cases.documents(spark).columns
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[900_001][0].text is None and got[900_001][0].n_lines == 0
    assert got[900_002][0].text == "" and got[900_002][0].n_lines == 1
    assert len(got[900_010]) == 2
    assert got[900_011][0].n_removed == 0
    assert got[900_012][0].n_removed == got[900_012][0].n_lines - len(got[900_012][0].text.split("\n"))
    assert line_chunks.deduplicated(cases.empty(spark)).count() == 0


def test_long_repeated_passages_of_lines_go(spark):
    lines = [f"line number {k} of a long passage that repeats" for k in range(80)]
    rows = [(k, "\n".join([f"own {k} {i}" for i in range(k + 1)] + lines + [f"end {k}"])) for k in range(6)]
    left = {r.doc_id: r for r in line_chunks.deduplicated(cases.documents(spark, rows)).collect()}
    assert left[0].n_removed == 0
    for k in range(1, 6):
        assert left[k].n_removed >= 60 and f"own {k} 0" in left[k].text and f"end {k}" in left[k].text


def test_passages_of_two_or_more_lines_go_whole(spark):
    """Against brute force: passages of 2 to 20 lines with blank lines and equal lines, planted in later documents."""
    r = random.Random(17)
    passages = [[r.choice(["", "same", f"p{k} {i}", f"p{k} {i}"]) if 0 < i < n - 1 else f"p{k} {i}" for i in range(n)] for k, n in enumerate(range(2, 21))]
    rows = [(k, "\n".join(p)) for k, p in enumerate(passages)]
    rows += [(100 + k, "\n".join([f"own {k}", *p, f"end {k}"])) for k, p in enumerate(passages)]
    rows += [(200, None), (201, ""), (202, "a\na\na\na"), (203, "a"), (None, "x\ny"), (204, "x\ny\nz"), (205, "z")]
    docs = cases.documents(spark, rows)
    left = {x.doc_id: x for x in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    for k, p in enumerate(passages):
        assert left[100 + k].text == f"own {k}\nend {k}" and left[100 + k].n_chars == len(left[100 + k].text)
    seen: set = set()
    for d, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = [] if text is None else re.split(line_chunks.UNIT_END, text)
        gone = set()
        for i in range(len(lines) - 1):
            two = (lines[i], lines[i + 1])
            if (two[0] + two[1]).strip() and two in seen:
                gone |= {i, i + 1}
            seen.add(two)
        want = [x for i, x in enumerate(lines) if i not in gone]
        assert (left[d].text if d in left else "") == (None if text is None else "\n".join(want))


def test_repeated_lines_go_also_between_other_lines(spark):
    """Only passages of two or more lines went: a line that had other neighbours each time stayed in every document."""
    r = random.Random(18)
    notice = "All rights are reserved here."
    said = [notice, "", " ", "}", "two words", "Thing.", "---", "\u6771\u4eac", "\tfour words in all ", "a much longer line that stands in several documents"]
    rows: list[tuple] = [(k, f"own {k} a\n{notice}\nown {k} b") for k in range(4)] + [(4, notice), (5, f"{notice}\n\n\n{notice}"), (6, None), (7, ""), (7, "other words"), (None, f"none\n{notice}")]
    rows += [(10 + k, "\n".join(r.choice([*said, f"own {k} {i}"]) for i in range(r.randrange(1, 9)))) for k in range(60)]
    left: dict = {}
    for x in corpus_pipeline.drop_repeated_lines(spark, cases.documents(spark, [*rows, rows[0]]).repartition(3), "").collect():
        left.setdefault(x.doc_id, []).append(x.text)
    assert left[None] == [f"none\n{notice}"] and left[0] == ["own 0 a\nown 0 b"] * 2 and 4 not in left and 5 not in left
    seen: set = set()
    for d, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = [] if not text else re.split(line_chunks.UNIT_END, text)
        gone = set()
        for i, line in enumerate(lines):
            for found in [(line,), tuple(lines[i : i + 2])][: 2 if i + 1 < len(lines) else 1]:
                if "".join(found).strip() and (len(found) == 2 or len(line.split()) > 1 or line == "\u6771\u4eac"):
                    gone |= set(range(i, i + len(found))) if found in seen else set()
                    seen.add(found)
        want = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if d != 7:
            assert left.get(d, [None])[0] == (None if text is None or gone and not want.strip() else want), d
    assert sorted(left[7]) == ["", "other words"]


def test_same_hash_of_different_chunks_is_told_apart(spark, monkeypatch):
    own = line_chunks.chunks
    monkeypatch.setattr(line_chunks, "chunks", lambda docs: own(docs).withColumn("h", F.lit(1).cast("bigint")))
    docs = cases.documents(spark)
    clash = {(r.doc_id, r.n_removed) for r in line_chunks.deduplicated(docs).collect()}
    monkeypatch.undo()
    assert clash == {(r.doc_id, r.n_removed) for r in line_chunks.deduplicated(docs).collect()}


def test_edited_texts_and_likeness(spark):
    rows = [x for x in cases.ODD if x[0] is not None and x[0] != 900_010] + cases.sample(spark)
    found = {r.doc_id: r for r in weighted_sampling.edit_probe(cases.documents(spark, rows).repartition(4)).collect()}
    ordered = sorted(rows, key=lambda x: -x[0])
    assert len(found) == len(rows)
    prints = {}
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        r = found[doc_id]
        assert r.n_chars == len(text) and bytes(r.edited_sha256).hex() == cases.sha(want)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        following = ordered[(k + 1) % len(ordered)][0]
        same = np.frombuffer(r.fingerprint, np.uint16) == np.frombuffer(found[following].fingerprint, np.uint16)
        assert r.near_next == same.mean()


def test_likeness_is_generalised_jaccard():
    r = random.Random(3)
    errors = []
    for k in range(60):
        pool = [f"p{i}" for i in range(400)]
        a = [r.choice(pool) for _ in range(500)]
        b = a[: r.randrange(500)] + [r.choice(pool) for _ in range(200)]
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        counts = [dict(), dict()]
        for own, words in zip(counts, (a, b)):
            for i in range(len(words) - 4):
                key = tuple(words[i : i + 5])
                own[key] = own.get(key, 0) + 1
        keys = set(counts[0]) | set(counts[1])
        want = sum(min(counts[0].get(x, 0), counts[1].get(x, 0)) for x in keys) / sum(max(counts[0].get(x, 0), counts[1].get(x, 0)) for x in keys)
        s = weighted_sampling.signatures(*weighted_sampling._packed(texts))
        errors.append(weighted_sampling.likeness(s[:1], s[1:])[0] - want)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25


@pytest.mark.parametrize("n", [50, 2000, 20_000, 60_000])
def test_collision_rate_is_generalised_jaccard_at_any_size(n):
    """Within three standard errors, for half the weights doubled and for weights of 1 to 5."""
    r = np.random.default_rng(n)
    times = 40 if n < 10_000 else 12
    doubled = np.where(np.arange(n) < n // 2, 2, 1)
    for one, two in ((np.ones(n, np.int64), doubled), (r.integers(1, 6, n), r.integers(1, 6, n))):
        want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
        got = []
        for _ in range(times):
            term = r.integers(0, 1 << 48, n, dtype=np.uint64)
            a, b = (weighted_sampling.sampled(np.zeros(n, np.int64), term, w, 1) for w in (one, two))
            got.append(weighted_sampling.likeness(a, b)[0])
        assert abs(np.mean(got) - want) < 3 * np.sqrt(want * (1 - want) / times / weighted_sampling.SAMPLES)


def test_edited_texts_with_null_and_repeated_ids(spark):
    """Every row has one answer; its edited text is made with some row that may follow it."""
    rows = [(3, "abcdef"), (3, "abcdef"), (3, "uvwxyz"), (2, None), (2, ""), (None, "last one"), (None, None), (1, "q" * 50)]
    found = weighted_sampling.edit_probe(cases.documents(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(d), len(t or "")) for d, t in rows)
    texts = {t or "" for _, t in rows}
    by_size: dict = {}
    for r in found:
        by_size.setdefault((r.doc_id, r.n_chars), []).append(bytes(r.edited_sha256).hex())
    for (doc_id, n), digests in by_size.items():
        own = [t or "" for d, t in rows if d == doc_id and len(t or "") == n]
        able = {cases.sha(t[: n - n // 2] + after[: n // 2]) for t in own for after in texts}
        assert set(digests) <= able
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1


def test_repeated_words_weigh_more():
    texts = [("a b c d e " * n).encode() for n in (1, 2, 50)]
    s = weighted_sampling.signatures(*weighted_sampling._packed(texts))
    assert (s[1] == s[2]).mean() < 0.3
    assert weighted_sampling.edit_probe is not None
