"""From documents to packed training sequences: quality classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and all but the last
return the columns of documents. Stages are written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import secrets
from tidegauge.llm.common import stage
from tidegauge.llm.ngrams import keep_one
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles one stays."""
    return keep_one(docs, n=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=200_000)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("best-fit packing", packing)]

#: The first stage fits a model, which SQL cannot express; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
