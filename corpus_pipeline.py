"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

language   language ID; documents of undetermined language go (no letters, or a score under
           LEAST_SCORE), the others keep their given lang
near       MinHash near-dedup; one document of each class stays, that of the least doc_id
secrets    secret scan; every reported span is replaced by a mark
mix        sources mixed to target weights: documents occur as often as the mix takes them
tokens     BPE; the last stage returns doc_id, source, n_tokens and digests of ids and decoded text

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and decides on text,
source and ids alone; all but the last return the columns of documents.  An empty table goes
through all stages as an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import bpe, langid, mixing, near_dedup, secret_scan
from weftlink.llm.common import fresh, materialise

#: A document whose bytes the network gives less for its best language than this is of none.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    label, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.predicted(docs, langid.fit(docs), (label, score))
    return found.filter((F.col(label) != "und") & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digest(docs, carry=("source",))


STAGES = [("language", language), ("near", near), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: Stages 1, 2 and 4 (a network, sampling by hashes) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
