"""Checks of submissions and feature tables, as tables of broken rules."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import parse_id_list
from ..sources.records import exists


def _rule(rows: DataFrame, name: str, example) -> DataFrame:
    """rule, n and the five least examples; no row if there is none."""
    x = rows.select(example.cast("string").alias("x"))
    least = x.distinct().orderBy("x").limit(5).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    return x.agg(F.lit(name).alias("rule"), F.count("*").alias("n")).filter("n > 0").crossJoin(least)  # one row each


def validate_submission(table: DataFrame, spine: DataFrame, corpus: DataFrame | None = None, column: str = "matched_entity_ids") -> DataFrame:
    """(rule, n, examples) for each broken rule of an id-list table; none for a valid one.

    spine: s1_id of every entity; corpus: id of every candidate, to look for unknown ids."""
    s1 = F.col("source1_entity_id")
    lists = table.select(s1, parse_id_list(F.col(column)).alias("ids"))
    # ids one by one, but for the rules that look at whole lists
    items = lists.select(s1, F.explode("ids").alias("id"))
    rules = [
        _rule(table.groupBy(s1).agg(F.count("*").alias("k")).filter("k > 1"), "duplicate entity", s1),
        _rule(lists.filter(F.size("ids") > F.size(F.array_distinct("ids"))), "duplicate id in a list", s1),
        _rule(items.filter(F.col("id").startswith("S1-")), "match within source 1", s1),
        _rule(items.filter(~F.col("id").rlike("^S[123]-")), "unknown prefix", F.col("id")),
        _rule(spine.select("s1_id").join(table.select(s1.alias("s1_id")), "s1_id", "left_anti"), "missing entity", F.col("s1_id")),
        _rule(table.select(s1.alias("s1_id")).distinct().join(spine.select("s1_id"), "s1_id", "left_anti"), "extra entity", F.col("s1_id")),
    ]
    if corpus is not None:
        rules.append(_rule(items.select("id").join(corpus.select("id"), "id", "left_anti"), "unknown id", F.col("id")))
    return reduce(DataFrame.unionByName, rules)


def validate_file(spark: SparkSession, path: str, spine: DataFrame, corpus: DataFrame | None = None, column: str = "matched_entity_ids") -> DataFrame:
    """(rule, n, examples) for each broken rule of an id-list file: that it exists, isn't empty, has a tab
    header with just these columns and rows of two fields; then validate_submission of its rows."""
    def one(rule: str, example: str) -> DataFrame:
        return spark.createDataFrame([(rule, 1, example)], "rule string, n long, examples string")

    if not exists(spark, path):
        return one("missing file", path)
    lines = spark.read.text(path).withColumn("cells", F.split("value", "\t", -1))
    head = spark.read.option("sep", "\t").option("quote", "").csv(path).limit(1).collect()
    if not head:
        return one("empty file", path)
    names = [str(c or "").strip().lower() for c in head[0]]
    if names != ["source1_entity_id", column]:
        return one("wrong header", ",".join(names))
    body = lines.filter(F.lower(F.trim(F.col("cells")[0])) != names[0]).filter(F.trim("value") != "")
    malformed = _rule(body.filter(F.size("cells") != 2), "malformed row", F.substring("value", 1, 80))
    table = body.filter(F.size("cells") == 2).select(F.trim(F.col("cells")[0]).alias("source1_entity_id"), F.col("cells")[1].alias(column))
    return malformed.unionByName(validate_submission(table, spine, corpus, column))


def file_is_valid(spark: SparkSession, path: str, spine: DataFrame, corpus: DataFrame | None = None, column: str = "matched_entity_ids") -> bool:
    return not validate_file(spark, path, spine, corpus, column).limit(1).count()


def integrity_report(matching: DataFrame, candidates: DataFrame, spine: DataFrame) -> DataFrame:
    """The checks of a pair of submission tables, each with the number of offences: rows that lack or exceed the
    spine, repeated entities, repeated ids in a list, one candidate under two entities, and matches that are no candidates."""
    s1 = F.col("source1_entity_id")

    def items(t: DataFrame, column: str) -> DataFrame:
        return t.select(s1.alias("s1_id"), F.explode(parse_id_list(F.col(column))).alias("cand_id"))

    m, c = items(matching, "matched_entity_ids"), items(candidates, "candidate_entity_ids")
    ids = matching.select(s1.alias("s1_id"))
    lists = matching.select(parse_id_list(F.col("matched_entity_ids")).alias("x"))
    checks = {
        "missing entities": spine.select("s1_id").join(ids, "s1_id", "left_anti"), "extra entities": ids.distinct().join(spine.select("s1_id"), "s1_id", "left_anti"),
        "repeated entities": ids.groupBy("s1_id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated ids in a list": lists.filter(F.size("x") > F.size(F.array_distinct("x"))),
        "shared candidates": m.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("n")).filter("n > 1"), "wrong prefix": m.filter(~F.col("cand_id").rlike("^S[23]-")),
        "uncovered matches": uncovered_matches(m, c),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, rows in checks.items()])


def uncovered_matches(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't candidates: a warning."""
    return matches.select("s1_id", "cand_id").join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")


def validate_features(rows: DataFrame, required: tuple[str, ...] = ("s1_id", "cand_id", "score")) -> tuple[bool, list[str]]:
    """Required columns, no nulls, scores within [0, 1] to a millionth, string ids."""
    errors = [f"missing column: {c}" for c in required if c not in rows.columns]
    if errors:
        return False, errors
    errors += [f"{c} is no string" for c in ("s1_id", "cand_id") if c in required and rows.schema[c].dataType.simpleString() != "string"]
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required]
    bad = F.sum((~F.col("score").between(-1e-6, 1 + 1e-6)).cast("long")).alias("__bad")
    got = rows.agg(*nulls, bad).first()
    errors += [f"{c} has {got[c]} nulls" for c in required if got[c]]
    if got["__bad"]:
        errors.append(f"score has {got['__bad']} values outside [0, 1]")
    return not errors, errors


def feature_violations(rows: DataFrame, required: tuple[str, ...] = ("s1_id", "cand_id", "score")) -> DataFrame:
    """Nulls of each required column and scores outside [0, 1]; one row."""
    return rows.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in required], F.sum((~F.col("score").between(-1e-6, 1 + 1e-6)).cast("long")).alias("bad_score"))
