"""The corpus pipeline: quality rules, SimHash near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of `docs`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from costlens.llm.packing import pack_documents
from costlens.llm.pii import redact
from costlens.llm.quality import keep_good, train
from costlens.llm.queries import tokenizer_path
from costlens.llm.simhash import drop_near_duplicates
from costlens.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (3-word shingles, 3 bits)."""
    return drop_near_duplicates(docs, words=3, bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

# SQL can express neither the fitted line labels nor the packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet under spark.checkpoint.dir and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
