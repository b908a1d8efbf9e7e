"""A pipeline over ``documents``: each stage is one operator of ``waneline.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waneline.llm import decontaminate, jaccard, packing, secrets, toxicity
from waneline.llm.text import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the factorization machine rejects go."""
    return toxicity.keep_clean(docs, toxicity.learned(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of documents linked by shared 5-word shingles (0.8 or more) one stays, that with the least id."""
    return jaccard.keep_one(docs, jaccard.Rule(5, 80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: every secret in a text is replaced by a mark; no document goes."""
    return secrets.redact(docs, secrets.trained())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: what is left, in sequences of at most 4096 tokens and 128 documents, which masks of attention have room for."""
    return packing.pack(docs, packing.vocabulary_path(), max_docs=128)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: The stages rest on trained models and tokenizers, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
