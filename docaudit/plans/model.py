"""The document model: paragraphs, sentences and words of a documents table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as T


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, lang, para (from 1) and text of every non-empty line; null texts have none."""
    return T.exploded(docs, ["doc_id", "lang"], T.paragraphs(F.col("text")), "text", "para").withColumn("para", F.col("para") + 1)


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, lang, para, sent (from 1 in its paragraph), text and n_words."""
    cut = T.exploded(paragraphs(docs), ["doc_id", "lang", "para"], T.sentences(F.col("text")), "text", "sent")
    return cut.withColumns({"sent": F.col("sent") + 1, "n_words": F.size(T.words(F.col("text")))})


def words(docs: DataFrame) -> DataFrame:
    """doc_id, lang, para, sent, pos (from 1 in its sentence) and word, bare and lower-cased."""
    cut = T.exploded(sentences(docs), ["doc_id", "lang", "para", "sent"], T.bare_words(F.col("text")), "word", "pos")
    return cut.withColumn("pos", F.col("pos") + 1)


#: The same tables in DuckDB's SQL; a query's SQL names them after WITH.
_NAMES = "|".join(a.replace(".", "\\.") for a in T.ABBREVIATIONS)
SQL = rf"""
paragraphs AS (
  SELECT doc_id, lang, unnest(range(1, len(p) + 1)) AS para, unnest(p) AS text FROM (
    SELECT doc_id, lang, list_filter(string_split(regexp_replace(regexp_replace(text, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: length(trim(x)) > 0) AS p FROM documents WHERE text IS NOT NULL)
), sentences AS (
  SELECT doc_id, lang, para, unnest(range(1, len(s) + 1)) AS sent, unnest(s) AS text FROM (
    SELECT doc_id, lang, para, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(^|[\s(])({_NAMES})\.\s+', '\1\2.' || chr(2), 'g'),
      '([.!?]["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(2), ' '))), lambda x: length(x) > 0) AS s FROM paragraphs)
), sized AS (
  SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 0)) AS n_words FROM sentences
), words AS (
  SELECT doc_id, lang, para, sent, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (
    SELECT doc_id, lang, para, sent, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda x: length(x) > 0) AS w FROM sentences)
)"""
