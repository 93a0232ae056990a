"""Packing: an exact round trip of the tokens, and the bounds that certify it."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docaudit.llm import packing, queries, tokens

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, found, capacity=packing.CAPACITY):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, places = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_doc, key=str) == sorted({d for d, _ in rows}, key=str)
    for doc_id, text in {d: t for d, t in rows}.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: (r.piece, r.sequence_id))
        times = sum(d == doc_id for d, _ in rows)
        own = own[::times]
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:]) and len(own) == -(-len(ids) // capacity)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_whole_table_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/documents.parquet").collect()]
    found = queries.op2_packing(spark, cases.DATA).collect()
    bins = check(rows, found)
    assert bins <= packing.lower_bound(np.array([r.length for r in found])) + 1


def test_odd_rows(spark):
    rows = cases.ODD
    found = packing.pack(packing.pieces(cases.documents(spark, rows), PATH)).collect()
    check(rows, found)
    assert packing.pack(packing.pieces(cases.empty(spark), PATH)).count() == 0


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(packing.pieces(cases.documents(spark), PATH, keep_ids=True))
    sizes = {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()}
    assert sum(sizes.values()) == sum(r.length for r in packed.collect()) and max(sizes.values()) <= packing.CAPACITY


@pytest.mark.parametrize("per_task", [7, 60])
def test_exchange_keeps_every_piece(spark, per_task):
    r = random.Random(per_task)
    sizes = [r.choice((r.randint(1, 100), r.randint(600, 1100), 2048)) for _ in range(400)]
    cut = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "doc_id bigint, length bigint")
    found = packing.pack(cut, per_task=per_task).collect()
    assert sorted((x.doc_id, x.length) for x in found) == list(enumerate(sizes))
    rooms = {}
    for x in found:
        rooms.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in rooms.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_bounds_never_exceed_the_best_packing():
    r = random.Random(1)

    def best(sizes, capacity):
        bins: list[int] = []
        least = len(sizes)

        def place(k):
            nonlocal least
            if len(bins) >= least:
                return
            if k == len(sizes):
                least = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= capacity:
                    bins[i] += sizes[k]
                    place(k + 1)
                    bins[i] -= sizes[k]
            bins.append(sizes[k])
            place(k + 1)
            bins.pop()

        place(0)
        return least

    for _ in range(120):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        exact = best(sizes, 20)
        _, _, used = packing.best_fit_decreasing(np.array(sizes), 20)
        assert packing.lower_bound(np.array(sizes), 20) <= exact <= used
    assert packing.lower_bound(np.array([11] * 9), 20) == 9


def test_ids_equal_the_tokenizers():
    texts = ["", " ", "it's  a\n\n test\t of 123 numbers, and ünïcode 日本 🙂 x", "don't they'll", " lead", "trail \n", "a b   c", "é" * 50, "\x1c x", "<|endoftext|> and <s>", "1/2 …", "²³ ½"]
    raw = [t.encode() for t in texts]
    ids, at = tokens.Encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
    plain = Tokenizer.from_file(PATH)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
