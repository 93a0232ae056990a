"""Where documents come from: tables, text and Markdown files, JSON lines and HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GRADE_ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("output", T.StringType()), T.StructField("reference", T.StringType()), T.StructField("sources", T.MapType(T.StringType(), T.StringType())),
    T.StructField("variant", T.StringType()), T.StructField("task", T.StringType()), T.StructField("language", T.StringType()), T.StructField("genre", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def text_files(spark: SparkSession, path: str, glob: str = "*.{md,markdown,mdx,txt}") -> DataFrame:
    """One document for each file below the path: doc_id is a hash of the path."""
    found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return found.select(F.xxhash64("source").alias("doc_id"), "text", guessed_language(F.col("text")).alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"))


def grade_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines; a line that is no item is a row with _corrupt_record."""
    return spark.read.schema(GRADE_ITEM).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def guessed_language(text: Column) -> Column:
    """ja where kana and kanji are 15 % or more of all but white space, else en."""
    marks = F.regexp_count(text, F.lit("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}]"))
    rest = F.length(F.regexp_replace(text, "\\s", ""))
    return F.when(marks * 100 >= 15 * F.greatest(rest, F.lit(1)), "ja").otherwise("en")


def _unescaped(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_title(html: Column) -> Column:
    return F.trim(_unescaped(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, nth, href and text of anchors."""
    pattern = "(?is)(<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"
    each = pages.where("html IS NOT NULL").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("nth", "raw"))
    return each.select("page_id", F.col("nth").cast("bigint").alias("nth"), F.regexp_extract("raw", "href=\"([^\"]*)\"", 1).alias("href"), F.trim(_unescaped(F.regexp_replace("raw", "<[^>]*>", ""))).alias("text"))


def html_text(html: Column) -> Column:
    """The paragraphs and headings of a page as Markdown lines, without scripts, styles, menus, notices and footers."""
    bare = F.regexp_replace(html, "(?is)<(script|style|nav|footer|aside|form|head)\\b.*?</\\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", "")
    for k in range(1, 5):
        bare = F.regexp_replace(bare, f"(?is)<h{k}[^>]*>", "\n" + "#" * k + " ")
    broken = F.regexp_replace(bare, "(?is)</?(p|h[1-6]|li|div|tr|article|section|ul|ol|table|body|html)\\b[^>]*>", "\n")
    plain = _unescaped(F.regexp_replace(F.regexp_replace(broken, "(?is)<br[^>]*>", " "), "(?s)<[^>]*>", ""))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def pages_as_documents(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("doc_id"), html_text(F.col("html")).alias("text"), F.lit(None).cast("string").alias("lang"), F.col("url").alias("source"))
