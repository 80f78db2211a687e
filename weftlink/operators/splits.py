"""Splits and samples by hashed order: the same rows on every run and partitioning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """A uniform order of rows by their keys, which other engines can compute too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_split(rows: DataFrame, key: str, strata: list[str], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with is_val: max(1, floor(n * fraction)) of each stratum."""
    w = Window.partitionBy(*strata)
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(fraction)))
    place = F.row_number().over(w.orderBy("__d", key))
    return rows.withColumn("__d", draw(seed, key)).withColumn("is_val", place <= n).drop("__d")


def holdout(rows: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The fraction of distinct keys that a hash puts first (by its value: no sort)."""
    part = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return rows.withColumn("is_val", part < fraction)


def folds(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """fold 0..k-1, equal for rows of one key."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k)))


def leave_one_out(spine: DataFrame, by: str) -> dict[str, DataFrame]:
    """The entities of each value, by its name in lower case."""
    return {str(r[0]).lower(): spine.filter(F.col(by) == r[0]) for r in spine.select(by).distinct().collect()}


def sample_negatives(pairs: DataFrame, ratio: float = 3.0, seed: int = 42) -> DataFrame:
    """All positives and ratio times as many negatives (all if there are fewer, or no positives)."""
    order = draw(seed, "s1_id", "cand_id")
    place = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    counts = pairs.groupBy("is_match", place.alias("place")).agg(F.count("*").alias("n")).collect()  # 2 x 65,536 rows at most
    positives = sum(r["n"] for r in counts if r["is_match"] == 1)
    negatives = sorted((r["place"], r["n"]) for r in counts if r["is_match"] == 0)
    wanted = int(positives * ratio)
    if not positives or sum(n for _, n in negatives) <= wanted:
        return pairs
    # places are the start of the order: all before the one where the sample ends are in, and that one alone is sorted
    last, left = 0, wanted
    for last, n in negatives:
        if n >= left:
            break
        left -= n
    rest = pairs.filter((F.col("is_match") == 0) & (place == last)).orderBy(order, "s1_id", "cand_id").limit(left)
    return pairs.filter((F.col("is_match") == 1) | (F.col("is_match") == 0) & (place < last)).unionByName(rest)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order column, by an aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(F.col(order).alias("__o"), *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, as a positive if it occurs as one."""
    return pairs.groupBy("s1_id", "cand_id").agg(F.max("is_match").alias("is_match"))
