"""Alignment of two tokenizers against a plain version, and the parts of its external counting."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from docaudit.llm import alignment, queries, tokens

from . import cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract's columns for each row, token by token."""
    model = Tokenizer.from_file(A)
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {ord(c): b for b, c in tokens._byte_letters().items()}
    bytes_a = {k: bytes(back[ord(c)] for c in t) for t, k in model.get_vocab().items() if all(ord(c) in back for c in t)}
    bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, pieces.id_to_piece(k)) for k in range(pieces.get_piece_size()))]
    counts, made = Counter(), []
    for doc_id, text in rows:
        a = model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        if not text or any(b"".join(own[x] for x in ids) != (" " + text).encode() for own, ids in ((bytes_a, a), (bytes_b, b))):
            made.append((doc_id, 0, 0, [], ""))
            continue
        ends_a = dict(zip(itertools.accumulate(len(bytes_a[x]) for x in a), range(len(a))))
        ends_b = dict(zip(itertools.accumulate(len(bytes_b[x]) for x in b), range(len(b))))
        links, groups, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            k, m = ends_a[end] + 1, ends_b[end] + 1
            links.append((a[k - 1], b[m - 1]))
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        counts.update(links)
        made.append((doc_id, len(a), len(b), links, cases.sha(";".join(groups))))
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((d, na, nb, len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for d, na, nb, x, h in made), key=str)


def found_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_query_equals_the_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/documents.parquet").collect()]
    assert found_rows(queries.op11_alignment(spark, cases.DATA)) == plain(rows)


def test_odd_rows(spark):
    rows = [*cases.ODD, (5, "a▁b"), (6, "<|endoftext|> <s> </s> <0x41>"), (7, "a\x00b\r\n"), (8, " "), (9, "  two  blanks "), (10, "　 ﬁ")]
    assert found_rows(alignment.align(cases.documents(spark, rows), A, B)) == plain(rows)
    assert alignment.align(cases.empty(spark), A, B).count() == 0


def test_runs_of_any_size_count_alike(spark, monkeypatch):
    rows = cases.sample(spark, 60) + cases.ODD[:6]
    docs = cases.documents(spark, rows)
    whole = found_rows(alignment.align(docs, A, B))
    monkeypatch.setattr(alignment, "RUN_BYTES", 4096)
    monkeypatch.setattr(alignment, "PASS_BYTES", 1024)
    assert found_rows(alignment.align(docs.coalesce(1), A, B)) == whole


def test_groups_spell_the_text(spark):
    rows = [(1, "Hello wörld, 123 tokens"), (2, None), (3, ""), (4, "x▁y")]
    pieces, model = sentencepiece.SentencePieceProcessor(model_file=B), Tokenizer.from_file(A)
    found = {r.doc_id: r.groups for r in alignment.groups_of(cases.documents(spark, rows), A, B).collect()}
    assert found[2] == found[3] == found[4] == []
    assert [x for g in found[1] for x in g.a] == model.encode(" " + rows[0][1], add_special_tokens=False).ids
    assert [x for g in found[1] for x in g.b] == pieces.encode(rows[0][1])


def test_numbers_survive_squeezing():
    r = np.random.default_rng(2)
    for x in (np.zeros(0, np.int64), np.array([5]), np.arange(100_000), r.integers(-(1 << 60), 1 << 60, 70_000), np.sort(r.integers(0, 1 << 47, 50_000))):
        assert np.array_equal(alignment.whole(alignment.squeezed(x)), x)


def test_heap_merge_of_many_runs():
    r = random.Random(4)
    made, counts = [], Counter()
    for _ in range(700):
        own = Counter(r.randint(0, 400) * (1 << 33) for _ in range(r.randint(0, 60)))
        counts.update(own)
        keys = np.array(sorted(own), np.int64)
        made.append((alignment.squeezed(keys), alignment.squeezed(np.array([own[k] for k in keys.tolist()], np.int64))))
    keys, n = alignment._merged_whole(made)
    assert dict(zip(keys.tolist(), n.tolist())) == counts and (np.diff(keys) > 0).all()
    parts = list(alignment.merged([iter([(np.array([1, 2]), np.array([1, 1])), (np.array([2, 9]), np.array([4, 1]))]), iter([(np.array([2]), np.array([5]))])]))
    assert {int(k): sum(int(c) for ks, cs in parts for k2, c in zip(ks, cs) if k2 == k) for ks, _ in parts for k in ks} == {1: 1, 2: 10, 9: 1}


def test_long_texts_are_cut_where_no_piece_crosses(monkeypatch):
    monkeypatch.setattr(tokens, "WHOLE", 7)
    encoder, r = tokens.piece_encoder(B), random.Random(7)
    texts = ["".join(r.choice(("a", "the", " ", "  ", "\n", "é", "日", "<s>", "\t", "x1")) for _ in range(r.randint(1, 30))) for _ in range(400)]
    raw = [(" " + t).encode() for t in texts]
    ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == encoder.model.encode(texts)


def test_hash_of_no_groups_is_empty(spark):
    (row,) = alignment.align(cases.documents(spark, [(1, "▁")]), A, B).collect()
    assert (row.n_a, row.groups_sha256) == (0, "") and hashlib.sha256(b"").hexdigest() != ""
