"""The registered queries opN_<name> and pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import langid, license, linedup, oracles
from postlake.llm.ann import nearest
from postlake.llm.decontam import benchmark_hits
from postlake.llm.divergence import source_divergence
from postlake.llm.jaccard import jaccard_components
from postlake.llm.license import scan_licenses
from postlake.llm.linedup import drop_template_lines
from postlake.llm.mixing import mix_sources
from postlake.llm.sharding import shard_documents
from postlake.llm.substring import drop_repeated_spans
from postlake.llm.suffixes import drop_earlier_bytes
from postlake.llm.tokenalign import align_tokenizers
from postlake.llm.toxicity import fit, toxic_passages

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_spans(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def held_out(remainder: int, of: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxic_passages(documents, fit(documents, labels.where(~held_out(0, 5))))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", predicted.alias("predicted"), "n_words", F.size("passages").cast("long").alias("n_passages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = langid.detect_languages(documents, langid.fit(documents.where(~held_out(2, 4))))
    return found.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_template_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, per_cent=5)
    items = F.sha2(F.array_join("items", ","), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.array_join("licenses", ",").alias("licenses"), "n_license_lines")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0), k=20)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_earlier_bytes(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = (op1_substring_dedup, op2_toxicity, op3_jaccard_join, op4_source_mixing, op5_sharding, op6_language_id, op7_line_dedup, op8_decontamination, op9_license_scan, op10_nearest_neighbours, op11_suffix_dedup, op12_token_alignment, op13_source_divergence)
    import corpus_pipeline  # which imports operators of this subpackage

    return {query.__name__: query for query in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": oracles.OP1, "op3_jaccard_join": oracles.OP3, "op8_decontamination": oracles.OP8, "op7_line_dedup": linedup.ORACLE_SQL, "op9_license_scan": license.oracle_sql(), "op11_suffix_dedup": oracles.OP11, "op13_source_divergence": oracles.OP13}
