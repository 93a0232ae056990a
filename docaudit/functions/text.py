"""Text as columns: line ends, paragraphs, sentences and words, in built-in functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stands between sentences while a paragraph is cut.
MARK = "\x01"
#: Abbreviations whose full stop ends no sentence (fixed values).
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Inc", "Ltd", "Co", "No", "Fig", "vs", "etc", "e.g", "i.e", "approx", "dept", "est")


def plain(text: Column) -> Column:
    """Without a byte order mark, with line feeds alone."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\\r\\n?", "\n")


def paragraphs(text: Column) -> Column:
    """Non-empty lines, in order."""
    return F.filter(F.split(plain(text), "\n", -1), lambda x: F.length(F.trim(x)) > 0)


def sentences(paragraph: Column) -> Column:
    """Cut behind . ! ? and closing marks before white space, but not behind an abbreviation."""
    names = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    held = F.regexp_replace(paragraph, f"(^|[\\s(])({names})\\.\\s+", "$1$2.\x02")
    cut = F.regexp_replace(held, "([.!?][\"')\\]]*)\\s+", f"$1{MARK}")
    back = F.transform(F.split(cut, MARK, -1), lambda x: F.trim(F.regexp_replace(x, "\x02", " ")))
    return F.filter(back, lambda x: F.length(x) > 0)


def words(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, "\\s+", -1), lambda x: F.length(x) > 0)


def bare(word: Column) -> Column:
    """A word in lower case without marks at its edges."""
    return F.lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))


def bare_words(text: Column) -> Column:
    """bare() of all white-space words that have a letter or digit, by one search of the text."""
    edge = r"[^\p{L}\p{N}\s]+"
    return words(F.lower(F.regexp_replace(text, rf"(?<!\S){edge}|{edge}(?!\S)", "")))


def fold(text: str) -> str:
    """NFKC in lower case without white space: full and half width, composed and decomposed forms are alike."""
    return unicodedata.normalize("NFKC", "".join(text.split())).lower()


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def folded(text: Column) -> Column:
    """fold() of each text, null for null; texts of ASCII alone stay in the JVM."""
    ascii_ = F.lower(F.regexp_replace(text, r"[\t-\r\x1c-\x20]+", ""))
    # Python gets nulls for the texts that it does not fold.
    other = F.octet_length(text) != F.length(text)
    return F.when(~other, ascii_).otherwise(_folded(F.when(other, text)))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """The compatibility composition of a text: full-width letters and half-width kana as the usual ones."""
    other = F.octet_length(text) != F.length(text)
    return F.when(~other, text).otherwise(_nfkc(F.when(other, text)))


def fingerprint(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts, white space runs as one blank."""
    return F.substring(F.sha2(F.concat_ws(" ", *(F.trim(F.regexp_replace(p.cast("string"), "\\s+", " ")) for p in parts)), 256), 1, 16)


def variation(sizes: Column) -> Column:
    """100 times the deviation over the mean of an array of whole numbers, rounded; null where the mean is 0.

    The squares are summed up one number behind the other: where the exact value lies between two whole numbers, the
    order of the sums decides, and parts summed up apart and then joined may give the other one.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"), F.lit(0).cast("bigint").alias("total"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"), (s["total"] + x).alias("total"))

    return F.aggregate(sizes, start, step, lambda s: F.round(F.when(s["total"] != 0, 100 * F.sqrt(s["squares"] / s["n"]) / (s["total"] / s["n"]))).cast("bigint"))


def held(x: Column, made: Callable[[Column], Column]) -> Column:
    """made(x), where x is made once however often it is used: as the variable of a lambda."""
    return F.get(F.transform(F.array(x), made), F.lit(0))


def shares(docs: DataFrame) -> int:
    """Twice the shuffle partitions, a stated number: by their compressed size alone texts would be put together, and their lines sorted by few tasks."""
    return 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exploded(df: DataFrame, keep: list[str], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """A row for each element, and its number from 0 if asked for; null and empty arrays have none.

    explode() brings a filter on empty arrays, which computes the array once more, below whatever it was made from;
    the outer form does not.
    """
    made = F.explode_outer(array).alias(name) if pos is None else F.posexplode_outer(array).alias(pos, name)
    return df.select(*keep, made).where(F.col(pos or name).isNotNull())
