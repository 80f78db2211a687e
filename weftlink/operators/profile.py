"""Profiles of sources and labels."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import PLACEHOLDERS


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def source_check(rows: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
    """rows, duplicate ids, ids without the prefix and empty values of each column; one pass."""
    empty = [F.sum((F.coalesce(c, F.lit("")) == "").cast("long")).alias(f"empty_{c}") for c in columns]
    return rows.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("entity_id")).alias("duplicate_ids"), F.sum((~F.col("entity_id").startswith(prefix)).cast("long")).alias("wrong_prefix"), *empty)


def length_stats(rows: DataFrame, column: str) -> DataFrame:
    n = F.length(F.coalesce(column, F.lit("")))
    return rows.agg(F.round(F.avg(n), 6).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg((n == 0).cast("double")), 6).alias("empty_share"))


def match_histogram(truth: DataFrame, spine: DataFrame, most: int = 5) -> DataFrame:
    """How many entities have 0, 1, ... matches; `most` and more are one bucket."""
    n = spine.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("m")), "s1_id", "left")
    return n.groupBy(F.least(F.coalesce("m", F.lit(0)), F.lit(most)).cast("long").alias("matches")).agg(F.count("*").alias("n"))


def label_stats(truth: DataFrame, spine: DataFrame) -> DataFrame:
    n = spine.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("m"), F.sum(F.col("cand_id").startswith("S2-").cast("long")).alias("m2")), "s1_id", "left").na.fill(0)
    return n.agg(F.count("*").alias("entities"), F.sum((F.col("m") == 0).cast("long")).alias("singletons"), F.sum("m").alias("links"), F.max("m").alias("most"), F.sum("m2").alias("links_s2"))


def label_shares(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Of the labels against the records: mean matches of all entities and of those with any, the share of
    entities without, the shares of both sources among the matches, and ids that no record has; one row.
    left, right: entity_id."""
    n = left.select(F.col("entity_id").alias("s1_id")).distinct().join(truth.groupBy("s1_id").agg(F.count("*").alias("m")), "s1_id", "left").na.fill(0)
    per = n.agg(F.avg("m").alias("mean_all"), F.avg(F.when(F.col("m") > 0, F.col("m"))).alias("mean_matched"), F.avg((F.col("m") == 0).cast("double")).alias("singleton_share"))
    known = right.select(F.col("entity_id").alias("cand_id"), F.lit(1).alias("known")).distinct()
    links = truth.join(known, "cand_id", "left").agg(*[F.avg(F.col("cand_id").startswith(f"{s}-").cast("double")).alias(f"share_{s.lower()}") for s in ("S2", "S3")], F.sum(F.col("known").isNull().cast("long")).alias("unknown_candidates"))
    lost = truth.select("s1_id").distinct().join(n.select("s1_id"), "s1_id", "left_anti").agg(F.count("*").alias("unknown_entities"))
    return per.crossJoin(links).crossJoin(lost)  # one row each


def frequent_values(rows: DataFrame, column: str, least: int = 50) -> DataFrame:
    """Values of at least so many rows, as countries that are worth leaving out."""
    return value_counts(rows, column).filter(F.col("n") >= least)


def class_balance(pairs: DataFrame) -> DataFrame:
    """positives, negatives, and negatives for each positive (null without any); one row."""
    p, n = F.sum((F.col("is_match") == 1).cast("long")), F.sum((F.col("is_match") == 0).cast("long"))
    return pairs.agg(p.alias("positives"), n.alias("negatives"), F.when(p > 0, n / p).alias("ratio"))


def crossed_balance(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """class_balance() of all pairs of equal keys, which are counted by key; left, right: (id, key)."""
    def counts(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy("key").agg(F.count("*").alias(n))

    pairs = counts(left, "l").join(counts(right, "r"), "key").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("pairs"))
    true = truth.select("s1_id", "cand_id").distinct().join(left.select(F.col("id").alias("s1_id"), "key"), "s1_id").join(right.select(F.col("id").alias("cand_id"), "key"), ["cand_id", "key"])
    p, n = F.col("positives"), F.col("negatives")
    both = true.agg(F.count("*").alias("positives")).crossJoin(pairs).select("positives", (F.col("pairs") - F.col("positives")).alias("negatives"))  # one row each
    return both.withColumn("ratio", F.when(p > 0, n / p))


def overview(sources: dict[str, DataFrame]) -> DataFrame:
    """source, country and rows of each; sources: records by name."""
    rows = [r.groupBy("country").agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), "country", "n") for k, r in sources.items()]
    return reduce(DataFrame.unionByName, rows)


def shared_candidates(truth: DataFrame) -> DataFrame:
    """Candidates of more than one entity."""
    return truth.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("n")).filter("n > 1")


def cooccurrence(truth: DataFrame) -> DataFrame:
    """Entities matched in both other sources, or in one alone."""
    by = truth.groupBy("s1_id").agg(F.max(F.col("cand_id").startswith("S2-")).alias("s2"), F.max(F.col("cand_id").startswith("S3-")).alias("s3"))
    return by.groupBy(F.when(F.col("s2") & F.col("s3"), "both").when(F.col("s2"), "only S2").otherwise("only S3").alias("where")).agg(F.count("*").alias("n"))


def pattern_share(rows: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    return rows.agg(*[F.round(F.avg(F.coalesce(F.col(column).rlike(p), F.lit(False)).cast("double")), 6).alias(k) for k, p in patterns.items()])


def common_values(rows: DataFrame, column: str, n: int = 30) -> DataFrame:
    return value_counts(rows, column).orderBy(F.desc("n"), column).limit(n)


def placeholder_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.lower(F.trim(F.coalesce(column, F.lit("")))).isin(*PLACEHOLDERS))


def equality_inventory(pairs: DataFrame) -> DataFrame:
    """Shares of matched pairs with equal names, equal addresses, or neither; columns name_a, name_b, addr_a, addr_b."""
    same = [F.lower(F.trim(a)) == F.lower(F.trim(b)) for a, b in (("name_a", "name_b"), ("addr_a", "addr_b"))]
    return pairs.agg(F.count("*").alias("n"), F.sum(same[0].cast("long")).alias("same_name"), F.sum(same[1].cast("long")).alias("same_address"), F.sum((~same[0] & ~same[1]).cast("long")).alias("differ_in_both"))


def country_consistency(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    j = truth.join(left.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("ca")), "s1_id").join(right.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("cb")), "cand_id")
    return j.agg(F.count("*").alias("links"), F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("same_country"))
