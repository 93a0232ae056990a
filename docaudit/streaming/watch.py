"""Watching a folder of documents: each micro-batch is checked, and counts by rule are compared with those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docaudit.operators.findings import pattern_findings
from docaudit.plans.rules import Settings


def counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, rule and n."""
    return pattern_findings(docs, settings=settings).select("doc_id", "rule", "n")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, rule, was and now where they differ; documents that are not in `after` are left alone."""
    seen = after.select("doc_id").distinct()
    old = before.join(seen, "doc_id", "left_semi").withColumnRenamed("n", "was")
    joined = old.join(after.withColumnRenamed("n", "now"), ["doc_id", "rule"], "full_outer")
    each = joined.select("doc_id", "rule", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    return each.where("was <> now")


def watch(spark: SparkSession, folder: str, state: str, checkpoint: str, schema: str, once: bool = True) -> StreamingQuery:
    """Reads new Parquet files of documents; each batch's counts and changes are appended below `state` by batch."""

    def batch(docs: DataFrame, epoch: int) -> None:
        now = counts(docs)
        now.write.mode("overwrite").parquet(f"{state}/counts/batch={epoch}")
        found = docs.sparkSession.read.parquet(f"{state}/counts")
        # The last count of each document and rule before this batch.
        old = found.where(F.col("batch") < epoch).groupBy("doc_id", "rule").agg(F.max_by("n", "batch").alias("n"))
        delta(old, found.where(F.col("batch") == epoch).drop("batch")).write.mode("overwrite").parquet(f"{state}/changes/batch={epoch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
