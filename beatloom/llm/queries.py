"""The registered queries of the subpackage and their checking SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beatloom.llm import (
    decontam,
    dialogue,
    language,
    near_dup,
    neighbours,
    periodic,
    pii,
    pseudo_likelihood,
    quality,
    secrets,
    segmentation,
    suffix,
    token_counts,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Path of the public SentencePiece model; BEATLOOM_PIECE_MODEL overrides it."""
    if path := os.environ.get("BEATLOOM_PIECE_MODEL"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir), piece_model())


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir))


@query("op5_quality_rules", quality.QUALITY_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir))


@query("op7_benchmark_decontamination", decontam.CONTAMINATION_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir), k=2)


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir))


@query("op2_pseudo_likelihood")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir))


@query("op4_sampled_segmentations")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.sample_segmentations(table(spark, sf_dir), piece_model())


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_report(table(spark, sf_dir, "conversations"))


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_report(table(spark, sf_dir, "embeddings"))
