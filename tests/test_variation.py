"""Variation of sizes whose exact value lies between two whole numbers: the order of the sums decides, as in the SQL."""

from __future__ import annotations

import duckdb
import pytest

from docaudit.operators import reports, structure
from docaudit.plans import catalogue

#: Words of each sentence; half of the sentences in the first paragraph.
HALVES = ([5, 3, 4, 6, 5, 5, 3, 1], [3, 5, 6, 5, 5, 4, 3, 1], [8, 8, 7, 8, 9, 9, 9, 6], [3, 1, 3, 7, 2, 3, 4, 9])
#: Letters and stop of each sentence, all in one paragraph: even ones.
SIZES = ([6, 2, 6, 14, 4, 6, 8, 18], [8, 2, 12, 2, 6, 10, 6, 18], [14, 4, 4, 2, 12, 8, 16, 4])


def rows_of(name: str, docs) -> list[tuple]:
    table = docs.toArrow()
    with duckdb.connect() as con:
        con.register("documents", table)
        return sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())


def test_measures_between_two_numbers_equal_the_sql(spark):
    said = lambda n: " ".join(["lamp"] * n) + "."
    texts = [" ".join(map(said, x[: len(x) // 2])) + "\n" + " ".join(map(said, x[len(x) // 2 :])) for x in HALVES]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate([*texts, "\t", None])], "doc_id bigint, lang string, text string")
    found = {r.doc_id: tuple(r) for r in reports.measures(docs).collect()}
    assert [found[k] for k in range(4)] == rows_of("structure_measures", docs.where("doc_id < 4"))
    # A sentence without words has a mean of 0.
    assert found[4][-1] is None and len(found) == 5


@pytest.mark.parametrize("parts", [1, 3])
def test_rhythm_between_two_numbers_equals_the_sql(spark, parts):
    texts = [" ".join("x" * (n - 1) + "." for n in x) for x in SIZES]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id bigint, lang string, text string").repartition(parts)
    found = sorted(tuple(r) for r in structure.sentence_rhythm(docs, 100).collect())
    sql = catalogue.oracle_sql()["sentence_rhythm"].replace("< 60", "< 100")
    with duckdb.connect() as con:
        con.register("documents", docs.toArrow())
        assert found == sorted(con.execute(sql).fetchall()) and len(found) == 3
