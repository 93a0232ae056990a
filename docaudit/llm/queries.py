"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import alignment, contamination, language, line_chunks, negatives, packing, pii, quality, sharding, simhash, site_tree, substrings, weighted_sampling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, tokenizer_path()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination.scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        contamination.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), keep_text=False)


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighted_sampling.edit_probe(table(spark, sf_dir, "documents"))
    named = {"edited_sha256": F.lower(F.hex("edited_sha256")), **{c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}}
    return found.withColumns(named)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs), keep=["doc_id"])
    return found.select("doc_id", (language.bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, ~quality.held_out(F.col("doc_id")))
    found = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, id_ = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    relabelled = vectors.withColumn("label", F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(relabelled, id_ % 100 == 0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sharding.shards(docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = (
    op1_site_tree, op2_packing, op3_decontamination, op4_substrings, op5_weighted_sampling, op6_pii, op7_line_chunks, op8_simhash, op9_language, op10_quality,
    op11_alignment, op12_negatives, op13_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_chunks": line_chunks.SQL, "op12_negatives": negatives.SQL}
