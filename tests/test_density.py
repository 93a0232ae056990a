"""Densest stretches against a search of every window."""

import random

from docaudit.operators import density


def test_densest_equals_every_window(spark):
    r = random.Random(5)
    rows = [(r.choice(("a", "b", None)), r.choice((None, *range(60)))) for _ in range(200)] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, p int")
    for width in (1, 7, 1000):
        want = {}
        for key in ("a", "b", None, "c"):
            own = sorted(p for k, p in rows if k == key and p is not None)
            n, first = max((sum(p <= q < p + width for q in own), -p) for p in own)
            want[key] = (-first, max(q for q in own if q < -first + width), n)
        assert {x.k: (x["first"], x["last"], x["n"]) for x in density.densest(df, ["k"], "p", width).collect()} == want
    assert density.densest(df.limit(0), ["k"], "p", 3).count() == 0


def test_rules_of_density_report_their_stretch(spark):
    plain = "word " * 400
    docs = spark.createDataFrame([(1, plain + "**a** **b** **c** " * 40 + plain, "en"), (2, plain, "en"), (3, None, "en")], "doc_id int, text string, lang string")
    (found,) = density.dense_stretches(docs).where("rule = 'bold-density'").collect()
    assert found.doc_id == 1 and len(plain) <= found.start and found.end <= len(plain) + 720 and found.n == 120
