"""A corpus from raw documents to packed sequences.

Each stage is ``fn(spark, docs, sf_dir) -> DataFrame`` over what the stage before kept,
and is written as Parquet and read again before the next. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialspark.llm import decontaminate, language, near_dups, packing, secret_ledger
from trialspark.llm.common import remainder, save, ship, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; profiles come from the labelled input."""
    ship(spark)
    return language.accepted(docs, language.learn(docs.where(remainder("doc_id", 4) != 2)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group that five-word shingles link at 0.8."""
    ship(spark)
    return near_dups.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with hits on one word in twenty or more; cut the hit spans of the others."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark."""
    return secret_ledger.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

#: no single SQL statement expresses rank-order profiles or the packing; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
