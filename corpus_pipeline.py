"""Corpus cleaning pipeline: good documents, one of each near-duplicate class,
without benchmark passages and secrets, as sampled piece ids."""

from __future__ import annotations

from beatloom.llm import decontam, near_dup, quality, secrets, segmentation
from beatloom.llm.queries import piece_model
from beatloom.session import materialise
from pyspark.sql import DataFrame, SparkSession

ORACLE_SQL = None  # sampling and automata have no SQL; tests compare with brute force


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejected documents go."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the first document of each class of five-word shingles stays."""
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with an exact benchmark phrase go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets are replaced by their kind."""
    return secrets.redact(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: two sampled segmentations of each document."""
    return segmentation.sample_segmentations(docs, piece_model())


STAGES = [
    ("quality rules", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", as_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
