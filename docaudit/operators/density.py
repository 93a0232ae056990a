"""Where things stand closest together: the densest stretch of each group, by windows over their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators import findings, masking
from docaudit.plans.rules import PATTERNS, Pattern, Settings


def densest(rows: DataFrame, key: list[str], position: str, width: int) -> DataFrame:
    """key, first, last and n of the stretch of `width` places that holds most rows; of equal ones the first.

    Places are whole numbers; a null place is nowhere; rows at one place count each; keys are null-safe. A stretch
    begins at a row and ends with the last row that it holds.
    """
    ahead = Window.partitionBy(*key).orderBy(position).rangeBetween(Window.currentRow, width - 1)
    each = rows.where(F.col(position).isNotNull()).select(*key, F.col(position).alias("first"), F.count("*").over(ahead).alias("n"), F.max(position).over(ahead).alias("last"))
    # The greatest n, and of those the least place: an aggregate, no second sort.
    best = F.max(F.struct("n", (-F.col("first")).alias("back"), "last"))
    return each.groupBy(*key).agg(best.alias("b")).select(*key, (-F.col("b.back")).alias("first"), F.col("b.last").alias("last"), F.col("b.n").alias("n"))


def dense_stretches(docs: DataFrame, width: int = 1000, rules: tuple[Pattern, ...] = PATTERNS, settings: Settings = Settings()) -> DataFrame:
    """doc_id, rule, start, end and n: for every density rule that a document breaks, the `width` characters with most matches.

    Matches are those of pattern_findings(), in the whole text. Documents are told apart by doc_id.
    """
    dense = tuple(r for r in rules if r.kind == "density")
    broken = findings.pattern_findings(docs, dense, settings).select("doc_id", "rule").distinct()
    found = masking.located(docs.join(broken.select("doc_id").distinct(), "doc_id", "left_semi"), masking.searches_of(dense, settings=settings), F.col("text"))
    kept = found.join(broken, ["doc_id", "rule"], "left_semi")
    ends = kept.select("doc_id", "rule", F.col("start").alias("last"), "end")
    best = densest(kept, ["doc_id", "rule"], "start", width)
    return best.join(ends, ["doc_id", "rule", "last"]).select("doc_id", "rule", F.col("first").alias("start"), "end", "n").distinct()
