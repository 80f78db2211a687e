"""Writers: submission tables, candidate tables, scores and features."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")


def id_lists(pairs: DataFrame, spine: DataFrame, order: list[Column], column: str) -> DataFrame:
    """source1_entity_id and the comma list of its cand_ids in order, each once; '' for those without any.

    spine: s1_id of every entity that must have a row."""
    ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("cand_id").alias("cand_id"))))
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["cand_id"])), ",").alias(column))
    return spine.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def matching_table(scored: DataFrame, spine: DataFrame, threshold: float) -> DataFrame:
    """Matches of score >= threshold, best first."""
    return id_lists(scored.filter(F.col("score") >= threshold), spine, [-F.col("score")], MATCHES[1])


def candidate_table(pairs: DataFrame, spine: DataFrame) -> DataFrame:
    """Candidates in rank order (by id where there is no rank)."""
    return id_lists(pairs, spine, [F.col("rank")] if "rank" in pairs.columns else [], CANDIDATES[1])


def write_tsv(rows: DataFrame, path: str, single: bool = True) -> None:
    """Tab-separated with a header; '' stays ''. single: one file, for tables a person hands in."""
    rows = rows.repartition(1) if single else rows  # lines are brought together; coalesce() would have one task make them
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").option("quote", "").csv(path)


def write_submission(scored: DataFrame, candidates: DataFrame, spine: DataFrame, threshold: float, folder: str) -> tuple[str, str]:
    to = f"{folder}/matching_results", f"{folder}/candidate_pairs"
    write_tsv(matching_table(scored, spine, threshold), to[0])
    write_tsv(candidate_table(candidates, spine), to[1])
    return to


def group_concat(pairs: DataFrame, column: str = "matches") -> DataFrame:
    """source1_entity_id and its cand_ids (in rank order where there is one, else by id); entities without
    any have no row."""
    lists = id_lists(pairs, pairs.select("s1_id").distinct(), [F.col("rank")] if "rank" in pairs.columns else [], column)
    return lists.filter(F.col(column) != "")


def scores_frame(scored: DataFrame, bi: DataFrame | None = None, truth: DataFrame | None = None, full: bool = False) -> DataFrame:
    """The canonical three columns; with another encoder's scores, labels or full=True, all rank features."""
    if bi is None and truth is None and not full:
        return canonical_scores(scored)
    from ..operators import decision

    if bi is None:
        bi = decision.ranked(canonical_scores(scored)).withColumnRenamed("score", "bi_score")
    return decision.rank_features(canonical_scores(scored), bi, truth)


def write_scores(scored: DataFrame, path: str, **options) -> None:
    """scores_frame as Parquet."""
    scores_frame(scored, **options).write.mode("overwrite").parquet(path)


def write_features(rows: DataFrame, path: str) -> dict[str, int]:
    """A feature table as Parquet, if it keeps the contract; ValueError otherwise.  Counts of pairs and entities."""
    from ..operators.validate import validate_features

    ok, errors = validate_features(rows)
    if not ok:
        raise ValueError("; ".join(errors))
    rows.write.mode("overwrite").parquet(path)
    got = rows.agg(F.count("*").alias("pairs"), F.countDistinct("s1_id").alias("entities")).first()
    return got.asDict()


def write_delimited(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Pairs or reports with a header, as a folder of files."""
    rows.write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """(id, v) with v as array<float>."""
    rows.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def canonical_scores(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("s1_id").cast("string").alias("s1_id"), F.col("cand_id").cast("string").alias("cand_id"), F.col("score").cast("double").alias("score"))


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def convert_to_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def convert_all(spark: SparkSession, files: dict[str, str], folder: str) -> DataFrame:
    """Every tab-separated file as Parquet under the folder; name, bytes before and after, and both as text."""
    from ..functions.normalize import bytes_text
    from .records import read_delimited

    out = []
    for name, path in files.items():
        convert_to_parquet(read_delimited(spark, path), f"{folder}/{name}")
        out.append((name, stored_bytes(spark, path), stored_bytes(spark, f"{folder}/{name}")))
    sizes = spark.createDataFrame(out, "name string, before long, after long")
    return sizes.withColumn("text", F.concat_ws(" -> ", bytes_text(F.col("before")), bytes_text(F.col("after"))))
