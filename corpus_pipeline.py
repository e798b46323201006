"""The corpus pipeline: documents to a clean, mixed training set.

STAGES, in order: toxic documents go, one document of each near-duplicate group
stays, documents with benchmark passages go, personal data is replaced by its
kind, and the rest is mixed to the target weights. Each function takes (spark,
docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, the last one adds ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.llm import decontam, mixing, pii, simhash, toxicity
from docstrata.session import stored_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("source_mixing", mix_sources),
]

#: Trees, fingerprints and random hashes are beyond the SQL of the check; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; ``docstrata.session.release`` drops what they stored."""
    at = stored_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
