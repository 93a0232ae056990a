"""Where findings go: Parquet, JSON lines, and SARIF runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_parquet(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").partitionBy("rule").parquet(path)


def to_json(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def sarif_results(found: DataFrame) -> DataFrame:
    """One SARIF result for each finding, as JSON in the column `value`; the wrapper of a run is the caller's."""
    level = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in LEVELS.items()), F.lit("none"))
    place = F.array(F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    message = F.struct(F.coalesce("quote", F.col("rule")).alias("text"))
    return found.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), message.alias("message"), place.alias("locations"))).alias("value"))


def has_errors(found: DataFrame) -> bool:
    """What a command's exit code says."""
    return not found.where("severity = 'error'").isEmpty()
