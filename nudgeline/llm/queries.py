"""The registered queries of the corpus operators. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cross_tokens,
    fingerprints,
    license_scan,
    line_dedup,
    mixing,
    near_dup,
    packing,
    personal_data,
    quality,
    sharding,
    token_counts,
    token_files,
    vector_codes,
)
from .common import documents

# Ids that the two token outputs put behind every document.
END_OF_TEXT, PACKING_END = 2, 0


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(documents(spark, sf_dir).select("doc_id", "text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir).select("doc_id", "text"), END_OF_TEXT)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"), PACKING_END)
    return packed.withColumn("length", F.col("length").cast("bigint"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shuffle(documents(spark, sf_dir).select("doc_id", "text"))
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir).select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model)


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align(documents(spark, sf_dir).select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_codes.compress(vectors).drop("label")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labelled = personal_data.labelled_spans(personal_data.sample_windows(docs))
    return personal_data.find(docs, personal_data.train(labelled))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_near_dup": op2_near_dup,
        "op3_token_files": op3_token_files,
        "op4_packing": op4_packing,
        "op5_mixing": op5_mixing,
        "op6_token_counts": op6_token_counts,
        "op7_sharding": op7_sharding,
        "op8_fingerprints": op8_fingerprints,
        "op9_license_scan": op9_license_scan,
        "op10_quality": op10_quality,
        "op11_cross_tokens": op11_cross_tokens,
        "op12_vector_codes": op12_vector_codes,
        "op13_personal_data": op13_personal_data,
    }
