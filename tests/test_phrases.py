"""Phrases are looked up in texts that are cut once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import findings


def test_phrases_cut_each_text_into_sentences_once(spark):
    docs = spark.createDataFrame([(1, "en", "Stone river.")], "doc_id bigint, lang string, text string")
    plan = findings.phrase_hits(docs)._jdf.queryExecution().optimizedPlan().toString()
    # One cut into paragraphs, one into sentences.
    assert plan.count("Generate posexplode") == 2


@pytest.mark.parametrize("text", ["(a)b. -- x--", " «Ab»\tc'd…\n\x0b__", "", "…", "ΟΔΟΣ. ΟΔΟΣ", "１a, 'tis; don't-"])
def test_bare_words_equal_words_made_bare(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(T.bare_words(F.col("text")).alias("a"), F.filter(F.transform(T.words(F.col("text")), T.bare), lambda x: F.length(x) > 0).alias("b")).first()
    assert row.a == row.b
