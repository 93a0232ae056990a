"""Code metrics over a table files(path, text): counts, sizes, mixes and what each dimension scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.session import checkpointed, scratch

#: Fixed values.
TYPED = ("ts", "tsx", "mts", "cts", "rs", "go", "java", "kt", "cs", "swift")
UNTYPED = ("js", "jsx", "mjs", "cjs", "py", "rb", "php")
SUPPRESSIONS = "eslint-disable|@ts-ignore|@ts-expect-error|@ts-nocheck|# noqa|# type: ignore|#\\[allow\\(|@SuppressWarnings|nolint"


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def source_files(files: DataFrame) -> DataFrame:
    """path, kind (source or test), ext, typed, text and sloc (lines with more than white space) of source files."""
    ext = _extension(F.col("path"))
    test = F.col("path").rlike("(^|/)(test|tests|__tests__|spec)/|[._-](test|spec)\\.[A-Za-z]+$|(^|/)test_[^/]*$")
    known = files.where("text IS NOT NULL").withColumn("ext", ext).where(F.col("ext").isin(*TYPED, *UNTYPED))
    return known.select("path", F.when(test, "test").otherwise("source").alias("kind"), "ext", F.col("ext").isin(*TYPED).alias("typed"), "text", F.regexp_count("text", F.lit("(?m)^.*\\S.*$")).cast("bigint").alias("sloc"))


def metrics(files: DataFrame, god_file: int = 500) -> DataFrame:
    """metric and value: suppressions, shape, mix, comments, tests and UI tokens, in one pass over the files."""
    each = source_files(files).withColumns({
        "suppressions": F.regexp_count("text", F.lit(SUPPRESSIONS)),
        "unreasoned": F.regexp_count("text", F.lit(f"(?m)(?:{SUPPRESSIONS})[^\\n:—]{{0,40}}$")),
        "comments": F.regexp_count("text", F.lit("(?m)^\\s*(?://|#|/\\*|\\*)")),
        "markers": F.regexp_count("text", F.lit("\\b(?:TODO|FIXME|HACK|XXX)\\b")),
        "inline": F.regexp_count("text", F.lit("style=\\{\\{|style=\"")),
        "swallowed": F.regexp_count("text", F.lit("catch\\s*(?:\\([^)]*\\))?\\s*\\{\\s*\\}|except[^:\\n]*:\\s*pass\\b")),
    })
    source, test = F.col("kind") == "source", F.col("kind") == "test"
    sum_ = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0)).cast("double")
    kloc = F.greatest(sum_("sloc", source) / 1000, F.lit(0.001))
    wide = each.agg(
        sum_("suppressions", source).alias("suppression_count"), (sum_("suppressions", source) / kloc).alias("suppression_per_kloc"), (sum_("unreasoned") / F.greatest(sum_("suppressions"), F.lit(1.0))).alias("suppression_unreasoned_ratio"),
        F.count_if(source & (F.col("sloc") > god_file)).cast("double").alias("god_files"), F.coalesce(F.max(F.when(source, F.col("sloc"))), F.lit(0)).cast("double").alias("max_sloc"), F.expr("coalesce(percentile(CASE WHEN kind = 'source' THEN sloc END, 0.95), 0.0)").alias("sloc_p95"),
        (sum_("sloc", F.col("typed")) / F.greatest(sum_("sloc"), F.lit(1.0))).alias("typed_sloc_ratio"), (sum_("comments") / F.greatest(sum_("sloc"), F.lit(1.0))).alias("comment_density"), (sum_("markers") / kloc).alias("marker_per_kloc"),
        F.count_if(test).cast("double").alias("test_files"), (sum_("sloc", test) / F.greatest(sum_("sloc", source), F.lit(1.0))).alias("test_source_ratio"), (sum_("inline") / kloc).alias("inline_style_per_kloc"), sum_("swallowed").alias("swallowed_failures"),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns)))
    return wide.select(rows.alias("m")).select("m.*")


def ui_tokens(files: DataFrame) -> DataFrame:
    """kind and n of distinct colours and spacings in the sources."""
    colours = F.regexp_extract_all(F.lower("text"), F.lit("(#[0-9a-f]{3,8}\\b|rgba?\\([^)]*\\))"), F.lit(1))
    spaces = F.regexp_extract_all("text", F.lit("\\b((?:margin|padding|gap)[a-zA-Z-]*:\\s*[0-9.]+(?:px|rem|em))"), F.lit(1))
    each = files.where("text IS NOT NULL").select(F.explode(F.concat(F.transform(colours, lambda x: F.struct(F.lit("colour").alias("kind"), x.alias("value"))), F.transform(spaces, lambda x: F.struct(F.lit("spacing").alias("kind"), x.alias("value"))))).alias("t"))
    return each.groupBy("t.kind").agg(F.count_distinct("t.value").alias("n"))


def readme_contract(files: DataFrame) -> DataFrame:
    """flag and documented: command line flags that sources define, and whether a README names them."""
    defined = source_files(files).where("kind = 'source'").select(F.explode(F.regexp_extract_all("text", F.lit("[\"'](--[a-z][a-z0-9-]+)[\"']"), F.lit(1))).alias("flag")).distinct()
    named = files.where(F.lower("path").rlike("(^|/)readme[^/]*$")).select(F.explode(F.regexp_extract_all("text", F.lit("(--[a-z][a-z0-9-]+)"), F.lit(1))).alias("flag")).distinct().withColumn("documented", F.lit(True))
    return defined.join(named, "flag", "left").select("flag", F.coalesce("documented", F.lit(False)).alias("documented"))


def import_edges(files: DataFrame) -> DataFrame:
    """a and b for every relative import of a file that is there."""
    raw = F.regexp_extract_all("text", F.lit("(?:from|import|require\\()\\s*[\"'](\\./[^\"']+)[\"']"), F.lit(1))
    stem = lambda c: F.regexp_replace(c, "\\.[A-Za-z]+$", "")
    own = files.where("text IS NOT NULL").select(stem(F.col("path")).alias("a"), F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder"), F.explode(raw).alias("raw"))
    edges = own.select("a", F.concat(F.coalesce("folder", F.lit("")), stem(F.regexp_replace("raw", "^\\./", ""))).alias("b"))
    return edges.join(files.select(stem(F.col("path")).alias("b")).distinct(), "b", "left_semi").select("a", "b").distinct()


def _trimmed(edges: DataFrame, kept) -> DataFrame:
    """The edges left when nodes without a way in or a way out are taken off until there are none."""
    n = edges.count()
    while True:
        inside = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges = kept(inside.select("a", "b"))
        now = edges.count()
        if now == n:
            return edges
        n = now


def _spread(edges: DataFrame, values: DataFrame, kept) -> DataFrame:
    """node and value: the greatest value from which edges lead to the node, its own included."""
    while True:
        sent = edges.join(values.select(F.col("node").alias("a"), "value"), "a").select(F.col("b").alias("node"), "value")
        now = kept(values.unionByName(sent).groupBy("node").agg(F.max("value").alias("value")))
        if now.join(values, ["node", "value"], "left_anti").isEmpty():
            return now
        values = now


def in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle of two nodes or more; those between cycles are not. Loops and repeated edges do not count.

    Each node takes the greatest node that leads to it; of those with one such colour, the ones from which edges of the
    colour lead back to it are a strongly connected component with it. They are taken off, and the rest goes on until
    nothing is left, however long the chains.
    """
    with scratch(edges.sparkSession) as kept:
        left = _trimmed(kept(edges.where("a <> b").select("a", "b").distinct()), kept)
        found = []
        while not left.isEmpty():
            nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
            colour = _spread(left, kept(nodes.select("node", F.col("node").alias("value"))), kept)
            named = lambda c: colour.select(F.col("node").alias(c), F.col("value").alias(f"colour_{c}"))
            same = kept(left.join(named("a"), "a").join(named("b"), "b").where("colour_a = colour_b").select(F.col("b").alias("a"), F.col("a").alias("b")))
            roots = kept(colour.select("node", (F.col("node") == F.col("value")).alias("value")))
            back = _spread(same, roots, kept).where("value").select("node")
            # A root that nothing of its colour leads back to is alone.
            found.append(kept(back.join(same.select(F.col("a").alias("node")), "node", "left_semi").join(same.select(F.col("b").alias("node")), "node", "left_semi")))
            out = lambda c: back.select(F.col("node").alias(c))
            left = _trimmed(kept(left.join(out("a"), "a", "left_anti").join(out("b"), "b", "left_anti").select("a", "b")), kept)
        if not found:
            return checkpointed(left.select(F.col("a").alias("node")))
        return checkpointed(reduce(DataFrame.unionByName, found).distinct())


def coverage(lcov: DataFrame) -> DataFrame:
    """kind and pct from the lines of an lcov report, in a column `value`."""
    number = F.regexp_extract("value", ":([0-9]+)", 1).try_cast("bigint")
    tag = F.regexp_extract("value", "^(LF|LH|BRF|BRH|FNF|FNH):", 1)
    sums = lcov.select(tag.alias("tag"), number.alias("n")).where("tag <> ''").groupBy().pivot("tag", ["LF", "LH", "BRF", "BRH", "FNF", "FNH"]).agg(F.sum("n"))
    ratio = lambda hit, all_: F.round(100.0 * F.col(hit) / F.nullif(F.col(all_), F.lit(0)), 2)
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), ratio(h, a).alias("pct")) for k, h, a in (("line", "LH", "LF"), ("branch", "BRH", "BRF"), ("function", "FNH", "FNF"))))).alias("r")).select("r.*")
