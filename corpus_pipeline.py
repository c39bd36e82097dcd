"""Pipeline from raw documents to packed training sequences.

Each stage is a function of (spark, documents, folder of tables); what it returns is
written as Parquet and read again as the documents of the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from defectlens.llm import decontaminate, line_dedup, ngram_join, packing, quality
from defectlens.llm.common import ready


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host is not rejected."""
    ready(spark)
    return quality.filter_documents(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are equal or similar to an earlier line of any document."""
    ready(spark)
    return line_dedup.drop_lines(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones; texts that have no words left are no copies of each other."""
    ready(spark)
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ready(spark)
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of 1024 token ids."""
    import public_tokenizers

    ready(spark)
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", unique_lines),
    ("ngram_join", unique_documents),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No statement: line similarity, latent retrieval and token ids have no SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what is between them lies in the shared folder."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
