"""Queries of this subpackage over the shared tables, with DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import byte_pairs, filter_audit, jaccard_join, licenses, line_dedup, media, oracles, packing, quality_classifier, quality_rules, secrets, sentencepieces, toxicity, whitening
from rangeloom.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_and_check(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out()))
    return quality_classifier.score(docs, model).withColumn("held_out", quality_classifier.held_out())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = secrets.train(secrets.labelled_samples(docs, spark))
    return secrets.report(secrets.scan(docs, model))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(whitening.Whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_toxicity, op3_line_dedup, op4_jaccard_join, op5_quality_rules, op6_license_scans,
             op7_media_columns, op8_quality_classifier, op9_packing, op10_secret_scans, op11_embedding_whitening, op12_filter_audit, op13_byte_pairs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
