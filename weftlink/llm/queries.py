"""The registered queries of the training-data operators: each over its whole table, whole texts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, contracts, langid, mixing, near_dedup, pitman_yor, quality, recompression, secret_scan, spotsigs, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = common.materialise(mixing.facts(_documents(spark, sf_dir), keep=("doc_id", "source")), "mix-facts")
    rows = mixing.planned(facts, written=True)
    return rows.select("__row.doc_id", "__row.source", "_mix.size", "_mix.source_size", "_mix.target", "_mix.copies", "_mix.taken")


def op3_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(_documents(spark, sf_dir))


def op4_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir))


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.spans_digest(_documents(spark, sf_dir))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(_documents(spark, sf_dir))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.deduplicated(_documents(spark, sf_dir))


_OPERATORS = {f.__name__: f for f in (op1_weighted_minhash, op2_pareto_mix, op3_bigru_language, op4_mcd_quality, op5_linked_secrets, op6_spotsigs, op7_pitman_yor, op8_bpe, op9_toxicity, op10_recompression)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _OPERATORS | contracts.queries(_OPERATORS)


def oracle_sql() -> dict[str, str]:
    return contracts.oracle_sql()
