"""Exact fractions and samples that keep what labels need, over rows in a given order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .splits import draw


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with `place`, from 0, in the given order.  Ranges of the order are numbered side by side and
    shifted by the rows before them, so no task holds more than a range."""
    cut = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return cut.withColumn("__own", own).join(F.broadcast(sizes), "__part").withColumn("place", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def exact_holdout(rows: DataFrame, key: str, fraction: float = 0.2, least: int = 1, seed: int | None = 42) -> DataFrame:
    """rows with is_val, true for max(least, floor(n * fraction)) of the n distinct keys: the first in
    hashed order, or in their own order if seed is None."""
    keys = rows.select(key).distinct()
    n = max(least, int(keys.count() * fraction))
    order = [key] if seed is None else ["__d", key]
    keys = keys if seed is None else keys.withColumn("__d", draw(seed, key))
    return rows.join(numbered(keys, *order).select(key, (F.col("place") < n).alias("is_val")), key)


def confusers(corpus: DataFrame, needed: DataFrame, most: int, order: str = "ord") -> DataFrame:
    """The first `most` rows of each source that aren't needed.  corpus: entity_id, source and the order."""
    other = corpus.join(needed.select(F.col("cand_id").alias("entity_id")).distinct(), "entity_id", "left_anti")
    w = Window.partitionBy("source").orderBy(order, "entity_id")
    return other.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def with_confusers(anchors: DataFrame, truth: DataFrame, corpus: DataFrame, most: int, order: str = "ord") -> DataFrame:
    """The rows of the corpus that anchors (s1_id) match, and `most` others of each source."""
    needed = truth.join(anchors.select("s1_id").distinct(), "s1_id", "left_semi")
    ids = needed.select(F.col("cand_id").alias("entity_id")).distinct()
    columns = corpus.columns
    return corpus.join(ids, "entity_id", "left_semi").select(columns).unionByName(confusers(corpus, needed, most, order).select(columns))


def truth_preserving(spine: DataFrame, truth: DataFrame, corpus: DataFrame, n: int, per: int = 5, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The first n entities, and a corpus that holds all their matches and n * per others of each source."""
    anchors = spine.orderBy(order, "s1_id").limit(n)
    return anchors, with_confusers(anchors, truth, corpus, n * per, order)


def leave_country_out(spine: DataFrame, truth: DataFrame, corpus: DataFrame, country: str, sample: int | None = None, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training entities, entities of the country, corpus), cut to about `sample` entities: a quarter, 20
    at least, of the country, the rest, 20 at least, of the others; all if there are fewer."""
    val, train = spine.filter(F.col("country") == country), spine.filter(F.col("country") != country)
    if sample is not None:
        n_val = max(20, min(int(sample * 0.25), val.count()))
        val, train = val.orderBy(order, "s1_id").limit(n_val), train.orderBy(order, "s1_id").limit(max(20, sample - n_val))
    both = train.select("s1_id").unionByName(val.select("s1_id"))
    return train, val, with_confusers(both, truth, corpus, max(5000, 5 * both.count()), order)


def matched_groups(truth: DataFrame, n: int = 8, seed: int = 42) -> DataFrame:
    """(s1_id, cand_id) of n entities that have matches, by hashed order."""
    keys = truth.select("s1_id").distinct().orderBy(draw(seed, "s1_id"), "s1_id").limit(n)
    return truth.join(keys, "s1_id", "left_semi").select("s1_id", "cand_id")
