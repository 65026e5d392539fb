"""The corpus pipeline: five stages over the documents, each written and read again.

Every stage but the last returns the columns it got, extra ones included; ``n_chars`` follows the
text where a stage changes it. Null and empty texts pass every filter: nothing in them is toxic,
repeated or secret. Labels are read from ``labels`` by the rule of op2_toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import jaccard_join, line_dedup, packing, registry, secrets, toxicity
from rangeloom.llm.common import written


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity models don't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of windows that an earlier one has."""
    return _with_length(line_dedup.dedup(docs, counts=False), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    model = secrets.train(secrets.labelled_samples(docs.select("text"), spark))
    return _with_length(secrets.redact(docs, model), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of every document's token pieces in the packed sequences."""
    return packing.pack(docs.select("doc_id", "text"), registry.tokenizer_path("word_bpe_49k.json"))


STAGES: list = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_duplicates),
                ("secret_scans", mask_secrets), ("packing", pack)]
#: No SQL form: tokenisation and trained models decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
