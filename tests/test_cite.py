"""Quotations against a plain search of the folded texts."""

import random
import unicodedata

from docaudit.operators import mentions


def fold(x):
    return unicodedata.normalize("NFKC", "".join(x.split())).lower()


def plain(quotes, sources):
    bodies: dict = {}
    for d, t in sources:
        if t is not None:
            bodies.setdefault(d, []).append(fold(t))
    out = []
    for q, d, quote in quotes:
        key = fold(quote or "")
        if d not in bodies:
            out.append((q, "missing-address"))
        elif key and any(key in b for b in bodies[d]):
            out.append((q, "ok"))
        else:
            out.append((q, "quote-elsewhere" if key and any(key in b for own in bodies.values() for b in own) else "quote-not-found"))
    return sorted(out)


def test_every_quote(spark, monkeypatch):
    r = random.Random(11)
    alphabet = ["ab", "a", "B", " ", "\n", "ｶﾞ", "ガ", "é", "é", "①", "(", "“", "　", "ß"]
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    sources = [(k, text(r.randint(0, 60))) for k in range(40)] + [(100, None), (101, ""), (7, "other abab text"), (None, "no id ab")]
    quotes = []
    for k in range(300):
        d, t = r.choice(sources)
        at = r.randrange(len(t or "x"))
        quotes.append((k, r.choice((d, r.randint(0, 45))), r.choice(((t or "")[at : at + r.randint(1, 9)], text(r.randint(1, 5))))))
    quotes += [(900, 3, None), (901, 3, " \n"), (902, 999, "ab"), (903, 100, "ab"), (904, 101, "ab"), (905, 7, "ABAB\ttext")]
    a, b = spark.createDataFrame(quotes, "quote_id int, doc_id int, quote string"), spark.createDataFrame(sources, "doc_id int, text string")
    known = [(d, t) for d, t in sources if d is not None]
    assert sorted(tuple(x) for x in mentions.cite(a.where("doc_id IS NOT NULL"), b.where("doc_id IS NOT NULL")).collect()) == plain([q for q in quotes if q[1] is not None], known)
    whole = sorted(x.key for x in mentions.held_anywhere(spark.createDataFrame([(fold(q),) for _, _, q in quotes if q and fold(q)], "key string"), b).collect())
    monkeypatch.setattr(mentions, "QUOTES_HELD", 40)
    assert whole == sorted(x.key for x in mentions.held_anywhere(spark.createDataFrame([(fold(q),) for _, _, q in quotes if q and fold(q)], "key string"), b).collect())
    assert whole == sorted({fold(q) for _, _, q in quotes if q and fold(q) and any(fold(q) in fold(t) for _, t in sources if t)})


def test_empty_tables(spark):
    quotes = spark.createDataFrame([], "quote_id int, doc_id int, quote string")
    sources = spark.createDataFrame([], "doc_id int, text string")
    assert mentions.cite(quotes, sources).count() == 0
    one = spark.createDataFrame([(1, 1, "x")], "quote_id int, doc_id int, quote string")
    assert [x.outcome for x in mentions.cite(one, sources).collect()] == ["missing-address"]
