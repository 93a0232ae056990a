"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.llm import negatives, queries

from . import cases

SCHEMA = "vec_id bigint, embedding array<double>, label int, anchor_id int, rank string"


def brute(rows, is_anchor):
    """(anchor, positive, rank, negative, scores) from all scores; rows are (vec_id, vector, label)."""
    known = [(k, v, tuple(math.floor(256 * x) for x in vec), label) for k, (v, vec, label) in enumerate(rows) if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    last = float("inf")
    found = []
    for k, v, vec, label in known:
        if v is None or not is_anchor(v):
            continue
        scores = sorted(((-sum(a * b for a, b in zip(vec, other)), last if w is None else w, own) for n, w, other, own in known if n != k), key=lambda x: x[:2])
        none = lambda w: None if w == last else w
        for s, w, _ in [x for x in scores if x[2] == label][: negatives.POSITIVES]:
            fits = [(t, n) for t, n, own in scores if own != label and 30 * -s <= 100 * -t <= 90 * -s][: negatives.NEGATIVES]
            found += [(v, none(w), rank, none(n), -s, -t) for rank, (t, n) in enumerate(fits, 1)]
    return sorted(found, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=str)


def made(n, seed, width=12, low=-1.0):
    r = random.Random(seed)
    rows = [(k, [r.uniform(low, 1) for _ in range(width)], r.choice((0, 0, 0, 1, 2))) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0], None), (n + 3, [math.nan] * width, 1), (n + 4, [None] * width, 1), (n + 5, [math.inf] + [0.1] * (width - 1), 0), (None, [0.5] * width, 1), (None, [0.5] * width, 0)]
    rows += [(n + 6, [0.5] * (width + 3), 0), (n + 7, [0.5] * 3, 1), (40, [0.25] * width, 0), rows[1], rows[1]]
    return rows + [(n + 10 + k, [0.75] * width, k % 2) for k in range(40)]


@pytest.mark.parametrize("low", [-1.0, 0.1])
def test_equals_all_scores(spark, monkeypatch, low):
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 15)
    rows = made(260, 5, low=low)
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)
    found = rows_of(negatives.mine(df, F.col("vec_id") % 9 == 0))
    assert found == brute(rows, lambda v: v % 9 == 0) and len(found) > 300


def test_query_equals_all_scores(spark):
    table = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{cases.DATA}/embeddings.parquet").collect()]
    assert rows_of(queries.op12_negatives(spark, cases.DATA)) == brute(table, lambda v: v % 100 == 0)


def test_numbers_beyond_doubles_and_empty_tables(spark):
    rows = [(k, [float(1 << 20) * (k + 1), 3.0, 1e-9], k % 2) for k in range(8)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)
    assert rows_of(negatives.mine(df, F.col("vec_id") < 2)) == brute(rows, lambda v: v < 2) != []
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_bounds_hold_every_row_that_counts():
    r = np.random.default_rng(1)
    rows, anchor = r.integers(-90, 90, (400, 50)).astype(float), r.integers(-90, 90, 50).astype(float)
    exact, seen = rows @ anchor, []

    def keep(least, most):
        seen.append(len(least))
        bar = np.partition(least, len(least) - 5)[len(least) - 5]
        return most >= bar

    alive, score = negatives.Columns(rows).scan(anchor, np.arange(400), keep)
    assert np.array_equal(score, exact[alive]) and set(np.argsort(-exact)[:5]) <= set(alive.tolist())
    assert len(seen) == 7 and seen[-1] < 200, "rows drop out before the last column"
