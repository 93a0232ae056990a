"""Reports over documents and findings: outline measures, sweeps of limits, grades, scores, fix plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import markdown
from docaudit.plans import model

PERCENTILES = (5, 10, 25, 50, 75, 90, 95)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and structure measures: paragraphs, sentences, words, sentences a paragraph, words a sentence, variation."""
    each = model.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("n_words").alias("words"), F.array_sort(F.collect_list(F.struct("para", "sent", "n_words"))).alias("sizes"))
    each = each.withColumns({"paragraphs": F.size(F.array_distinct(F.col("sizes.para"))).cast("bigint"), "mean": F.col("words") / F.col("sentences")})
    return each.select(
        "doc_id", "paragraphs", "sentences", "words", F.round(F.col("sentences") * 10 / F.col("paragraphs")).cast("bigint").alias("sentences_10_paragraphs"), F.round("mean").cast("bigint").alias("words_a_sentence"), T.variation(F.col("sizes.n_words")).alias("variation"),
    )


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, line, depth, text and n_words under each heading up to the next."""
    heads = markdown.headings(docs)
    following = heads.withColumn("next", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line")))
    body = markdown.lines(docs).select("doc_id", F.col("line").alias("at"), F.size(T.words(F.col("text"))).alias("n"))
    joined = following.join(body, "doc_id", "left").where((F.col("at") >= F.col("line")) & (F.col("next").isNull() | (F.col("at") < F.col("next"))))
    each = joined.groupBy("doc_id", "line", "depth", "text").agg(F.sum(F.when(F.col("at") > F.col("line"), F.col("n")).otherwise(0)).alias("n_words"))
    return each


def percentiles(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """measure and p5 to p95, by nearest rank."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in columns))).alias("m")).select("m.*")
    ranks = [F.expr(f"CAST(percentile_disc({p / 100}) WITHIN GROUP (ORDER BY value) AS BIGINT)").alias(f"p{p}") for p in PERCENTILES]
    return stacked.where("value IS NOT NULL").groupBy("measure").agg(*ranks)


def sweep(values: DataFrame, value: str, limits: tuple[int, ...]) -> DataFrame:
    """limit, findings and documents for each limit, in one pass: how many values are over it, in how many documents."""
    aggs = []
    most = values.groupBy("doc_id").agg(*(F.count_if(F.col(value) > k).alias(f"n{k}") for k in limits))
    for k in limits:
        aggs += [F.sum(f"n{k}").alias(f"f{k}"), F.count_if(F.col(f"n{k}") > 0).alias(f"d{k}")]
    wide = most.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("limit"), F.coalesce(f"f{k}", F.lit(0)).cast("bigint").alias("findings"), F.coalesce(f"d{k}", F.lit(0)).cast("bigint").alias("documents")) for k in limits)))
    return wide.select(rows.alias("r")).select("r.*")


def recommended(swept: DataFrame, documents: int, share: float = 0.05, least: int = 20) -> DataFrame:
    """The strictest limit that at most `share` of the documents meet; none for fewer than `least` documents."""
    return swept.where((F.lit(documents) >= least) & (F.col("documents") <= share * documents)).orderBy("limit").limit(1)


def ai_score(signals: DataFrame, measured: DataFrame, usual: DataFrame) -> DataFrame:
    """doc_id, signs and verdict. signals(doc_id, rule), measured(doc_id, measure, value), usual(measure, p90).

    A sign is a different rule that fired or a measure beyond p90, and one more where three come together.
    """
    fired = signals.groupBy("doc_id").agg(F.count_distinct("rule").alias("a"))
    beyond = measured.join(F.broadcast(usual), "measure").where("value > p90").groupBy("doc_id").agg(F.count_distinct("measure").alias("b"))
    each = fired.join(beyond, "doc_id", "full_outer").select("doc_id", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))
    signs = each.select("doc_id", (F.col("n") + F.when(F.col("n") >= 3, 1).otherwise(0)).cast("bigint").alias("signs"))
    return signs.withColumn("verdict", F.when(F.col("signs") >= 5, "high").when(F.col("signs") >= 3, "medium").otherwise("low"))


def fix_plan(found: DataFrame, structural: tuple[str, ...] = ("max-sentence-length", "max-paragraph-length", "ngram-repetition")) -> DataFrame:
    """rule, documents, findings and depth of rewriting, the most frequent first by order of n."""
    each = found.groupBy("rule").agg(F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("findings"))
    return each.withColumn("depth", F.when(F.col("rule").isin(*structural), "structure").otherwise("light"))


def grade(items: DataFrame, most: int = 400) -> DataFrame:
    """item_id, passed and reasons. items(item_id, output, reference): nulls count as empty.

    Reasons: empty, too long (over `most` words), repeats (half or more of the words are repeated), missing numbers
    (of the reference), unlike (fewer than one word in ten shared with the reference).
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    w, r = T.bare_words(text(F.col("output"))), T.bare_words(text(F.col("reference")))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(text(F.col(c)), F.lit("([0-9]+)"), F.lit(1)))
    each = items.select("item_id", w.alias("w"), r.alias("r"), F.size(F.array_except(numbers("reference"), numbers("output"))).alias("lost"))
    n, d = F.size("w"), F.size(F.array_distinct("w"))
    shared = F.size(F.array_intersect("w", "r"))
    reasons = F.filter(
        F.array(
            F.when(n == 0, "empty"), F.when(n > most, "too long"), F.when((n >= 20) & (d * 2 <= n), "repeats"), F.when(F.col("lost") > 0, "missing numbers"),
            F.when((F.size("r") > 0) & (shared * 10 < F.size(F.array_distinct("r"))), "unlike"),
        ),
        lambda x: x.isNotNull(),
    )
    return each.select("item_id", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def compare_grades(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items on both sides whose grade changed: item_id, was and now."""
    joined = before.select("item_id", F.col("passed").alias("was")).join(after.select("item_id", F.col("passed").alias("now")), "item_id")
    return joined.where("was <> now")


def linear_score(value: Column, good: Column, bad: Column) -> Column:
    """100 at `good` or better, 0 at `bad` or worse, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (bad - value) / (bad - good))) * 100


def rubric(metrics: DataFrame) -> DataFrame:
    """dimension and score. metrics(dimension, metric, state, value, good, bad, weight): absent scores 0, skipped is left out."""
    score = F.when(F.col("state") == "absent", 0.0).otherwise(linear_score(F.col("value"), F.col("good"), F.col("bad")))
    kept = metrics.where("state <> 'skipped'").withColumn("s", score)
    return kept.groupBy("dimension").agg(F.round(F.sum(F.col("s") * F.col("weight")) / F.sum("weight"), 4).alias("score"))


def ratchet(before: DataFrame, after: DataFrame, slack: float = 0.0) -> DataFrame:
    """Dimensions whose score fell by more than `slack`: dimension, was and now."""
    joined = before.select("dimension", F.col("score").alias("was")).join(after.select("dimension", F.col("score").alias("now")), "dimension")
    return joined.where(F.col("now") < F.col("was") - slack)
