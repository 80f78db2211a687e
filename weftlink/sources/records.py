"""Readers of records, labels, pairs and id lists; '' is a value, not a null."""
from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import parse_id_list, strip

RECORD = ("entity_id", "business_name", "business_address", "country")


class SchemaError(ValueError):
    """A table that lacks columns, or holds ids of another source."""


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as strings, by the header; empty fields are ''."""
    rows = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    return rows.na.fill("")


def require(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return rows


def load_source(spark: SparkSession, path: str, expected_prefix: str | None = None) -> DataFrame:
    rows = require(read_delimited(spark, path), RECORD)
    if expected_prefix is not None:
        wrong = rows.filter(~F.col("entity_id").startswith(expected_prefix)).limit(5).collect()
        if wrong:
            raise SchemaError(f"ids without the prefix {expected_prefix}: {[r['entity_id'] for r in wrong]}")
    return rows


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, matches array<string>."""
    rows = read_delimited(spark, path)
    column = next((c for c in ("matched_entity_ids", "matches") if c in rows.columns), None)
    if column is None or "source1_entity_id" not in rows.columns:
        raise SchemaError("labels need source1_entity_id and matched_entity_ids (or matches)")
    return rows.select(F.col("source1_entity_id").alias("s1_id"), parse_id_list(F.col(column)).alias("matches"))


def label_pairs(labels: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of labels; entities without matches have none, so keep the spine beside it."""
    return labels.select("s1_id", F.explode("matches").alias("cand_id")).distinct()


def load_bundle(spark: SparkSession, folder: str, labelled: bool = True) -> dict[str, DataFrame]:
    """s1, s2, s3 and labels of a training folder, or s1, s2, s3 of a test folder."""
    kind = "train" if labelled else "test"
    out = {f"s{k}": load_source(spark, f"{folder}/{kind}_source{k}.tsv", f"S{k}-") for k in (1, 2, 3)}
    if labelled:
        names = [n for n in ("train_ground_truth.tsv", "train_labels.tsv") if exists(spark, f"{folder}/{n}")]
        if not names:
            raise FileNotFoundError(f"no labels in {folder}")
        out["labels"] = load_labels(spark, f"{folder}/{names[0]}")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def candidate_corpus(s2: DataFrame, s3: DataFrame) -> DataFrame:
    return s2.withColumn("source", F.lit("S2")).unionByName(s3.withColumn("source", F.lit("S3")))


def load_candidates(spark: SparkSession, path: str, score: float | None = None) -> DataFrame:
    """s1_id, cand_id, rank (from 1, list order) of a candidate table; a constant score if given."""
    rows = read_delimited(spark, path)
    names = ("source1_entity_id", "candidate_entity_ids")
    a, b = names if set(names) <= set(rows.columns) else rows.columns[:2]
    out = rows.select(F.col(a).alias("s1_id"), F.posexplode(parse_id_list(F.col(b))).alias("rank", "cand_id")).withColumn("rank", F.col("rank") + 1)
    return out if score is None else out.withColumn("score", F.lit(score))


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).filter("id <> ''")


def load_first_column(spark: SparkSession, path: str) -> DataFrame:
    """The first tab field of every line, the header's too, with no quoting."""
    return spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("id"))


def load_pairs(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """Pairs by the file's kind (.parquet, .pq, a folder, .csv, .tsv); label pairs if there is no such file."""
    if not exists(spark, path):
        if labels is None:
            raise FileNotFoundError(path)
        return label_pairs(labels)
    kind = Path(path).suffix.lower()
    rows = read_delimited(spark, path, "," if kind == ".csv" else "\t") if kind in (".csv", ".tsv") else spark.read.parquet(path)
    return pair_names(rows)


#: Other names of the pair's columns.
ALIASES = {"source1_entity_id": "s1_id", "entity_id_1": "s1_id", "candidate_entity_id": "cand_id", "candidate_id": "cand_id", "entity_id_2": "cand_id"}


def pair_names(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in rows.columns and b not in rows.columns})


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an order column: a prefix scan that doesn't depend on partitions."""
    return rows.orderBy(order).limit(n)


def data_dir(variable: str = "WEFTLINK_DATA", candidates: tuple[str, ...] = ("data", "dataset"), marker: str = "train_source1.tsv") -> Path:
    """The folder an environment variable names, or the first candidate folder there is, or the folder below
    this one that holds the marker file."""
    given = os.environ.get(variable)
    for p in ([Path(given)] if given else []) + [Path(c) for c in candidates]:
        if p.is_dir():
            return p
    found = sorted(Path().rglob(marker))
    if found:
        return found[0].parent
    raise FileNotFoundError(f"no data folder: set {variable}")


def assert_files(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Raises if any of the files isn't there."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")


def load_features(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """A feature table, checked by the contract unless told otherwise."""
    from ..operators.validate import validate_features

    rows = spark.read.parquet(path)
    ok, errors = validate_features(rows) if validate else (True, [])
    if not ok:
        raise ValueError("; ".join(errors))
    return rows


def embeddings_frame(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return rows.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).cast(T.ArrayType(T.FloatType())).alias("v"))
