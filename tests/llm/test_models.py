"""Chains, language ID, quality and personal data: against enumeration, plain matching and held-out rows."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from docaudit.llm import language, pii, quality, queries
from docaudit.llm.crf import Chain

from . import cases


def chain(labels=3, features=4, seed=0):
    r = np.random.default_rng(seed)
    c = Chain(features, labels)
    c.weights, c.move, c.start = r.normal(size=(features, labels)), r.normal(size=(labels, labels)), r.normal(size=labels)
    return c, r


def test_marginals_and_viterbi_equal_enumeration():
    c, r = chain()
    sizes = [4, 1, 0, 5, 2]
    offsets = np.r_[0, np.cumsum(sizes)]
    e = r.normal(size=(sum(sizes), 3))
    p, _ = c.marginals(e, offsets)
    best = c.viterbi(e, offsets)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if a == b:
            continue
        ways = list(itertools.product(range(3), repeat=b - a))
        score = np.array([c.start[w[0]] + sum(e[a + k, x] for k, x in enumerate(w)) + sum(c.move[x, y] for x, y in zip(w, w[1:])) for w in ways])
        weight = np.exp(score) / np.exp(score).sum()
        for k in range(b - a):
            want = [weight[[w[k] == y for w in ways]].sum() for y in range(3)]
            assert np.allclose(p[a + k], want)
        assert tuple(best[a:b]) == ways[int(score.argmax())]


def test_phrases_equal_plain_matching():
    texts = {"aa": "the cat sat on the mat and the dog ran", "bb": "le chat est sur le tapis et le chien court"}
    found = language.Automata(texts)
    for text in ("the cat ran on", "le chien est", "zzz 9 qqq!", "", "a", "Le the  CAT"):
        counts, sizes = found.phrases([text])
        symbols = found.encode(text.lower())
        symbols = [x for k, x in enumerate(symbols) if x or (k and symbols[k - 1])]
        symbols = symbols[:-1] if symbols and symbols[-1] == 0 else symbols
        assert sizes[0] == len(symbols)
        for k, name in enumerate(found.languages):
            known = found.encode(language.letters(texts[name])).tolist()
            parts, at = 1 if symbols else 0, 0

            def holds(own, known=known):
                return any(known[j : j + len(own)] == own for j in range(len(known)))

            for i in range(len(symbols)):
                if not holds(symbols[at : i + 1]):
                    # The symbol that fails begins the next phrase; one that no text has stands between two.
                    parts, at = parts + 1, i if holds(symbols[i : i + 1]) else i + 1
            assert counts[0, k] == parts


def test_lanes_do_not_change_phrases():
    r = np.random.default_rng(4)
    letters = "abcdeüz "
    texts = {k: "".join(r.choice(list(letters[:-2] + " "), 3000)) for k in ("aa", "bb")} | {"cc": "ab" * 400}
    found = language.Automata(texts)
    many = ["".join(r.choice(list(letters), n)) for n in (0, 1, 5, 300, 2000)] + ["ab" * 700, "abab" * 100 + "z" + "ba" * 300, texts["aa"][:1500]]
    want, sizes = found.phrases(many, lane=10**6)
    for lane in (1, 2, 7, 64, 1024):
        got, again = found.phrases(many, lane=lane)
        assert (got == want).all() and (again == sizes).all()


def test_training_rows_are_whole_and_bounded(spark):
    rows = [(k, f"word{k} " * 9, "en") for k in range(40)] + [(100, "x" * 9000, "de"), (101, "y" * 5000, "de"), (1, "word1 " * 9, "en"), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.training_rows(docs, F.lit(True), rows=5)
    assert list(found) == ["en", "de"] and found["de"] == "y" * 5000
    assert found["en"].count("word") == 45 and all(x == "word" for x in found["en"].split())


def test_symbols_of_a_large_alphabet_cost_no_table():
    text = "".join(chr(0x4E00 + (k * 7919) % 5000) for k in range(12_000))
    found = language.Automata({"zh": text, "en": "plain words"})
    assert found.table.nbytes + found.roots.nbytes < 1_000_000
    assert found.phrases([text[50:5000]])[0].tolist()[0][0] == 1


def test_columns_named_like_the_answers_stay_in_the_filter(spark):
    docs = cases.documents(spark, [(k, "der schnelle braune fuchs und der hund " * 3) for k in range(40)]).withColumn("score", F.lit(7)).withColumn("lang", F.lit("de"))
    kept = language.known_languages(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {7} and kept.count() == 40


def test_language_of_held_out_rows(spark):
    found = queries.op9_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred != 'und'").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in found.collect())


def test_language_of_odd_rows(spark):
    docs = cases.documents(spark)
    found = {r.doc_id: r for r in language.identify(docs, {"en": "the quick brown fox", "de": "der schnelle braune fuchs"}).collect()}
    assert {d for d, r in found.items() if r.lang_pred == "und"} == {900_001, 900_002, 900_003, 900_005}
    assert all(found[d].score == 0 for d in (900_001, 900_002, 900_003, 900_005))
    assert language.train(cases.empty(spark)) == {}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(cases.empty(spark), {}).count() == 0


def area(scores, labels) -> float:
    up, down = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down]))


def test_quality_of_held_out_rows(spark):
    found = queries.op10_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.9
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85
    assert found.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_quality_of_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(900_004, 1), (900_005, 0), (900_006, 1), (900_011, 0), (900_011, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(cases.ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.train(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(cases.empty(spark), model).count() == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
PRIVATE = [
    "write to a.b+c@mail.example.com, or x@y@z.org. and a@b.c@d.e; no@domain",
    "host 10.0.0.1 and 300.1.1.1, 1.2.3.4.5.6.7.8, 0010.1.1.01 or 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 1234567890123",
    "call +1 (555) 123-4567 or +12 34 or +1234567890123456",
    "🙂 é +49 30 1234567, mail ü@example.com",
]


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rows = cases.ODD + cases.sample(spark) + list(enumerate(PRIVATE, 500_000))
    found = pii.find(cases.documents(spark, rows)).collect()
    got, want = [], []
    for r in found:
        got.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    for d, t in rows:
        own = plain_base(t or "")
        want.append((d, *(sum(k == kind for k, _, _ in own) for kind, _ in PATTERNS), cases.sha(",".join(f"{k}:{a}:{b}" for k, a, b in own))))
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in found:
        base = {f"{k}:{a}:{b}" for k, a, b in plain_base(dict(rows)[r.doc_id] or "")}
        assert base <= set(r.spans.split(",")) | {""}
    assert pii.find(cases.empty(spark)).count() == 0


def test_the_field_adds_spans():
    text = "Reach me: (555) 010-9999 or 555-010-9998. SSN 123-45-6789, password=abcdef0123456789ab and 42 apples on 2024-05-06."
    base = pii.base_spans(text)
    added = {(k, text[a:b]) for k, a, b in pii.added_spans(text, base, pii.model())}
    assert ("phone", "(555) 010-9999") in added and ("phone", "555-010-9998") in added and ("id", "123-45-6789") in added
    assert ("secret", "abcdef0123456789ab") in added
    assert not any(x in {"42", "2024-05-06"} for _, x in added)


def test_values_without_digits_and_names_are_found():
    chain = pii.model()
    for text, want in (
        ("password=correcthorsebattery", {("secret", "correcthorsebattery")}),
        ('the token = "qwertyuiopasdf" here', {("secret", "qwertyuiopasdf")}),
        ("Name: Anna Schmidt", {("name", "Anna Schmidt")}),
        ("ask Dr. Kowalski about it", {("name", "Kowalski")}),
        ("lives at 12 Maple Street now", {("address", "12 Maple Street")}),
        ("the key point is that the name of the street must change", set()),
        ("They walked down the road and call it home", set()),
    ):
        assert {(k, text[a:b]) for k, a, b in pii.added_spans(text, [], chain)} == want


def test_recall_of_the_field_on_lines_it_was_not_trained_on():
    """By kind, over lines of another seed and with words of another alphabet around the values."""
    chain, found, there, extra, plain = pii.model(), {}, {}, 0, 0
    for words, labels in pii.labelled_table(400, seed=99):
        text, spans, at = " ".join(words), [], 0
        for word, label in zip(words, labels):
            a, b = pii._core(word)
            if label.endswith("+"):
                spans[-1] = (spans[-1][0], spans[-1][1], at + b)
            elif label != "out":
                spans.append((label, at + a, at + b))
            at += len(word) + 1
        got = pii.added_spans(text, [], chain)
        for kind, a, b in spans:
            there[kind] = there.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + any(k == kind and x < b and a < y for k, x, y in got)
        extra += sum(not any(x < b and a < y for _, a, b in spans) for _, x, y in got)
        plain += labels.count("out")
    assert set(there) == {"phone", "id", "secret", "name", "address"}
    assert all(found[k] >= 0.9 * there[k] for k in there), (found, there)
    assert extra < 0.02 * plain


def test_spans_over_nested_base_spans():
    base = [("card", 0, 200), ("ip", 5, 9)]
    text = "x" * 150 + " 555-010-9998"
    assert pii.added_spans(text, base, pii.model()) == []


def test_blocks_of_languages_find_what_all_at_once_find(spark, monkeypatch):
    texts = {f"l{k}": " ".join(f"{'abcdefgh'[k % 8]}{'aeiou'[x % 5]}{'klmno'[(k * x) % 5]}{'pqrst'[x % 3]}" for x in range(45)) for k in range(7)} | {"twin": "", "en": "the quick brown fox"}
    texts = {k: language.letters(v) or "the quick brown fox" for k, v in texts.items()}
    docs = cases.documents(spark, [*cases.ODD, *((k, " ".join(list(texts.values())[k % 9].split()[k : k + 6])) for k in range(40))])
    want = sorted(map(str, language.identify(docs, texts).select("doc_id", *language.COLUMNS).collect()))
    for size in (1, 2, 4):
        monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", size)
        found = language.identify(docs, texts)
        assert sorted(map(str, found.select("doc_id", *language.COLUMNS).collect())) == want
        assert found.columns == [*docs.columns, *language.COLUMNS]
    assert language.identify(cases.empty(spark), texts).count() == 0
