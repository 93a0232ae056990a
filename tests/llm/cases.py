"""Small tables for the tests: the smallest documents beside nulls, ties, repeated rows and odd texts."""

from __future__ import annotations

import hashlib
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PASSAGE = " ".join(f"shared{k % 37}x{k}" for k in range(60))
LONG = " ".join(f"w{k % 997} v{k % 31}" for k in range(9000))

#: doc_id, text: null and empty, white space alone, one word, a letterless text, a very long one, a null id, repeated rows.
ODD = [
    (900_001, None),
    (900_002, ""),
    (900_003, " \t\n\x0b "),
    (900_004, "one"),
    (900_005, "12345 67890 !!"),
    (900_006, LONG),
    (900_007, "Ünïcode – café naïve word 日本語 🙂 end"),
    (900_008, f"before it {PASSAGE} and after"),
    (900_009, f"elsewhere {PASSAGE}"),
    (900_010, "same row twice in here"),
    (900_010, "same row twice in here"),
    (900_011, "line one\nline two\nline three\nline four\nline five\nline six"),
    (900_012, "top\nline one\nline two\nline three\nline four\nline five\nline six\nend"),
    (None, "a row without an id"),
]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def documents(spark, rows=None, name: str = "documents"):
    """The given rows (the odd ones by default) with the columns of documents, and extra ones with names operators use."""
    made = [(i, t, "en", "tests", len(t or ""), 7, "x") for i, t in (ODD if rows is None else rows)]
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, items string")


def sample(spark, most: int = 150):
    """doc_id and text of the smallest documents table, by id."""
    found = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(most).collect()
    return [(r.doc_id, r.text) for r in found]


def empty(spark):
    return documents(spark, [])
