"""Decontamination and substring dedup against plain loops over words."""

from __future__ import annotations

import re

import numpy as np
import pytest

from docaudit.llm import contamination, queries, substrings

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def scanned(rows, items, window=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text or ""))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    for doc_id, text in rows:
        words = WORD.findall(lowered(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(words[k : k + n])]
        yield doc_id, len(words), len(hit), len(found), cases.sha(",".join(sorted(found)))


@pytest.mark.parametrize("limit", [contamination.BLOCK_BYTES, 700])
def test_scan_equals_loops(spark, limit):
    items = [(1, cases.PASSAGE), (2, "one"), (12, "ONE"), (3, None), (4, ""), (5, "Café NAÏVE"), (6, cases.LONG[:400]), (7, " ".join(cases.PASSAGE.split()[5:25]))]
    items += [(r.item_id + 100, r.text) for r in spark.read.parquet(f"{cases.DATA}/benchmark.parquet").collect()]
    rows = cases.ODD + cases.sample(spark)
    found = contamination.scan(cases.documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), limit=limit)
    got = [(r.doc_id, r.n_words, r.hit, len(r["items"]), cases.sha(",".join(r["items"]))) for r in found.withColumn("hit", contamination.n_hit()).collect()]
    assert sorted(got, key=str) == sorted(scanned(rows, items), key=str)


def test_query_over_a_whole_table_equals_loops(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.op3_decontamination(spark, cases.DATA).collect()}
    assert got == {(*x, x[2] > 0) for x in scanned(rows, items)}


def test_removal(spark):
    items = spark.createDataFrame([(1, cases.PASSAGE)], "item_id bigint, text string")
    docs = cases.documents(spark, [(1, f"Keep this, please: {cases.PASSAGE}! And this too, " + "of many more words " * 30), (2, f"x {cases.PASSAGE}"), (3, None), (4, "clean text stays")])
    left = {r.doc_id: r for r in contamination.cleaned(docs, items).collect()}
    assert set(left) == {1, 3, 4}
    assert left[1].text == "Keep this, please: ! And this too, " + "of many more words " * 30 and left[1].n_chars == len(left[1].text)
    assert left[4].text == "clean text stays" and left[3].text is None and left[4].n_words == 7
    assert {r.doc_id for r in contamination.without_documents(docs, items).collect()} == {3, 4}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.cleaned(cases.documents(spark), items).count() == len(cases.ODD)
    assert contamination.scan(cases.empty(spark), items).count() == 0
    assert substrings.deduplicated(cases.empty(spark)).count() == 0


def stripped(rows, window=13):
    words = [(d if d is not None else substrings.NULL_ID, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, d), d)
    for (d, w), (own, _) in zip(words, rows):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        yield own, len(w), len(gone), cases.sha(" ".join(x for k, x in enumerate(w) if k not in gone))


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 4000])
def test_substrings_equal_loops(spark, shard_bytes):
    copies = [(700 + k, f"head {k} " + cases.PASSAGE + f" tail {k}") for k in range(40)] + [(800 + k, "again and " * 40) for k in range(5)]
    rows = cases.ODD + cases.sample(spark) + copies
    docs = cases.documents(spark, rows).repartition(5)
    spans_by_shard = substrings.repeated_spans(docs, shard_bytes=shard_bytes)
    assert spans_by_shard.count() > 0
    found = substrings.deduplicated(docs)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=str) == sorted(stripped(rows), key=str)
    for r in found.collect():
        assert cases.sha(r.text) == r.kept_sha256


def test_substrings_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/documents.parquet").collect()]
    got = {tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in queries.op4_substrings(spark, cases.DATA).collect()}
    assert got == set(stripped(rows))


def test_items_without_an_id_hit_but_are_not_listed(spark):
    window = " ".join(f"w{k}" for k in range(10))
    items = spark.createDataFrame([(None, window), ("b", "x y"), ("c", None)], "item_id string, text string")
    docs = cases.documents(spark, [(1, f"so {window} it"), (2, "x y z"), (3, "nothing")])
    found = {r.doc_id: r for r in contamination.scan(docs, items).collect()}
    assert [(h.start, h.end) for h in found[1]["hits"]] == [(1, 11)] and found[1]["items"] == []
    assert found[2]["items"] == ["b"] and found[3]["hits"] == []


def test_many_rows_of_one_id_and_of_none(spark):
    rows = [(1, cases.PASSAGE)] + [(None, f"n{k} " + (cases.PASSAGE if k % 10 == 0 else "nothing here")) for k in range(3000)]
    rows += [(7, f"s{k} " + (cases.PASSAGE if k % 5 == 0 else "or here " * 20)) for k in range(300)]
    found = substrings.deduplicated(cases.documents(spark, rows).repartition(4), keep_text=False).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(stripped(rows), key=str)


def test_fragments_with_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc bb", np.uint8)
    low = np.array([0, 3, 6, 9, 12])
    assert substrings._groups(np.zeros(5, np.uint64), data, low, low + 2).tolist() == [0, 1, 0, 2, 1]
    assert substrings._groups(np.array([1, 1, 2, 3, 3], np.uint64), data[[0, 1, 2, 0, 1, 2, 6, 7, 2, 9, 10, 2, 9, 10]], low, low + 2).tolist() == [0, 0, 1, 2, 2]
