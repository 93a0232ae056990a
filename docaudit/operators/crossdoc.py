"""Rules over all documents of a run: links from file to file, and terms that files define in other words.

docs has path and text; a path counts from the run's top, with / between folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import markdown, masking, tree

EXTENSIONS = ("md", "markdown", "mdx")
#: Pages that a link to a folder opens.
FOLDER_PAGES = ("index.md", "index.mdx", "README.md")
#: What says that a sentence defines a term.
DEFINES = r"[\"“]([A-Z][^\"”\n]{0,60})[\"”]\s+(?:means|shall mean|has the meaning|refers to)\s+([^\n]*?[.;](?=\s|$)|[^\n]*$)"


def normal_path(path: Column) -> Column:
    """The path without . and empty parts, each .. taken with the folder before it; those above the top stay."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    step = lambda s, x: F.when((x == "..") & (F.size(s) > 0) & (F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("..")) != ".."), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.array_append(s, x))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/+$", "")


def link_targets(docs: DataFrame) -> DataFrame:
    """path, line, text and target of links to files of the run; file (normal), folder (whether it names one) and fragment.

    Links to URLs, to absolute paths, within the page, to files that are not Markdown, and images are left out.
    """
    plain = docs.select(F.col("path").alias("doc_id"), masking.without_code(T.plain(F.col("text"))).alias("text"))
    found = markdown.links(plain).where("NOT image").withColumn("written", F.trim("target"))
    own = found.where((F.col("written") != "") & ~F.col("written").rlike(r"(?i)^(?:[#/\\]|[a-z][a-z0-9+.-]*:)"))
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    part = decoded(F.regexp_extract("written", r"^([^#?]*)", 1))
    fragment = F.when(F.contains("written", F.lit("#")), decoded(F.regexp_extract("written", r"#(.*)$", 1)))
    each = own.withColumns({"part": part, "fragment": fragment}).withColumn("extension", F.lower(F.regexp_extract("part", r"[^/.][^/]*\.([^./]*)$", 1)))
    kept = each.where((F.col("extension") == "") | F.col("extension").isin(*EXTENSIONS))
    file = normal_path(F.concat_ws("/", folder_of(normal_path(F.col("doc_id"))), "part"))
    return kept.select(F.col("doc_id").alias("path"), "line", "text", F.col("written").alias("target"), file.alias("file"), ((F.col("part") == "") | F.col("part").endswith("/")).alias("folder"), (F.col("extension") != "").alias("named"), F.nullif("fragment", F.lit("")).alias("fragment"))


def anchors(docs: DataFrame) -> DataFrame:
    """file and anchor of headings (the second of equal ones ends in -1, and so on) and of ids in HTML."""
    heads = markdown.headings(docs.select(F.col("path").alias("doc_id"), "text")).withColumn("slug", markdown.slug(F.col("text")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("line")) - 1
    named = heads.select(normal_path(F.col("doc_id")).alias("file"), F.when(nth == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", nth)).alias("anchor"))
    ids = F.regexp_extract_all(masking.without_code(T.plain(F.col("text"))), F.lit(r"(?i)<[a-z][^<>\n]*?\b(?:id|name)\s*=\s*[\"']([^\"'\n]+)[\"']"), F.lit(1))
    return named.unionByName(T.exploded(docs.where("text IS NOT NULL"), [normal_path(F.col("path")).alias("file")], ids, "anchor").select("file", F.lower("anchor").alias("anchor"))).distinct()


def broken_links(docs: DataFrame) -> DataFrame:
    """path, line, text, target and variant (file, anchor) of links that lead nowhere in the run.

    file: the run has files in the folder of the target, but not it; a folder that has files below it is none. anchor:
    the file is there, its heading is not. Null texts have no links and no anchors, but are files; paths that differ in
    ./ or .. alone are one file; repeated rows report their links each.
    """
    files = docs.select(normal_path(F.col("path")).alias("file")).distinct()
    links = link_targets(docs).withColumn("nth", F.monotonically_increasing_id())
    others = [F.concat("file", F.lit(f".{e}")) for e in EXTENSIONS] + [normal_path(F.concat("file", F.lit(f"/{p}"))) for p in FOLDER_PAGES]
    tried = links.select("*", F.posexplode(F.when(F.col("named"), F.array("file")).otherwise(F.array("file", *others))).alias("rank", "tried"))
    there = files.select(F.col("file").alias("tried"), F.lit(True).alias("there"))
    met = tried.join(there, "tried", "left")
    known = F.min(F.when(F.col("there"), F.struct("rank", "tried")))
    each = met.groupBy("nth", "path", "line", "text", "target", "file", "folder", "fragment").agg(known.alias("met"))
    folders = files.select(folder_of(F.col("file")).alias("in_folder")).distinct()
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda k: F.array_join(F.slice(F.split("file", "/"), 1, k), "/"))).alias("above"), "file")
    above = above.where("above <> file").select("above").distinct()
    lost = each.where("met IS NULL AND NOT folder").withColumn("in_folder", folder_of(F.col("file")))
    lost = lost.join(folders, "in_folder", "left_semi").join(above, F.col("file") == F.col("above"), "left_anti")
    led = each.where("met IS NOT NULL AND fragment IS NOT NULL").select("path", "line", "text", "target", F.col("met.tried").alias("file"), F.lower("fragment").alias("anchor"))
    dead = led.join(anchors(docs), ["file", "anchor"], "left_anti")
    out = ["path", "line", "text", "target"]
    return lost.select(*out, F.lit("file").alias("variant")).unionByName(dead.select(*out, F.lit("anchor").alias("variant")))


def definitions(docs: DataFrame) -> DataFrame:
    """path, line, term and body (white space as one blank, without the mark at its end) of each file's first definition of a term."""
    lines = tree.lines(docs.select(F.col("path").alias("doc_id"), "text"))
    said = F.regexp_extract_all("text", F.lit(DEFINES), F.lit(0))
    each = T.exploded(lines.where(F.col("text").rlike(DEFINES)), ["doc_id", "line"], said, "said", "nth")
    body = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("said", DEFINES, 2), r"\s+", " ")), "[.;]$", "")
    own = each.select("doc_id", F.regexp_extract("said", DEFINES, 1).alias("term"), F.struct("line", "nth", body.alias("body")).alias("d"))
    first = own.groupBy("doc_id", "term").agg(F.min("d").alias("d"))
    return first.select(F.col("doc_id").alias("path"), "d.line", "term", "d.body")


def definitions_out_of_step(docs: DataFrame) -> DataFrame:
    """path, line, term, files and example of definitions in other words than in most files that define the term.

    Each file has one vote; of wordings with equal votes the one in the first file by path is the usual. files counts
    those that define the term, example is the first that has the usual words.
    """
    votes = definitions(docs)
    counts = votes.groupBy("term", "body").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    # Sums and extremes alone, so that a term of all files is no group in one task.
    most = counts.groupBy("term").agg(F.max("n").alias("most"), F.sum("n").alias("files"), F.count("*").alias("bodies")).where("bodies > 1")
    usual = counts.join(most, "term").where("n = most").groupBy("term", "files").agg(F.min(F.struct("first", "body")).alias("usual"))
    odd = votes.join(usual, "term").where(F.col("body") != F.col("usual.body"))
    return odd.select("path", "line", "term", "files", F.col("usual.first").alias("example"))
