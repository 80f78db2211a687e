"""Trees over pairs that are scored as matrices."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.operators import boosted, decision, matrix


def cuts(values):
    values = sorted(values)
    found = [values[max(1, -(-k * len(values) // boosted.BINS)) - 1] for k in range(boosted.BINS)]
    return sorted({float(x) for x in found if x > found[0]})


@pytest.mark.parametrize("missing", [False, True])
def test_pairs_are_ranked_and_binned_as_rows(spark, frame, monkeypatch, missing):
    """Scores are those of Spark's trees on pairs made one by one: ties, null scores, entities of several rows and keys, null and repeated ids."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    for name, n in (("SHARE", 64), ("LEAST", 3), ("MOST", 5)):
        monkeypatch.setattr(boosted, name, n)
    near = lambda a, b: 1 - np.abs(a - b) / 8  # noqa: E731  a function of this module is no one's to import
    rng = random.Random(3)
    value = lambda: rng.choice([None, 20.5, -4.0] if missing and rng.random() < 0.3 else [float(rng.randrange(8)), rng.randrange(80) / 10])
    left = [(f"A{i}", rng.choice([1, 2, 2, None]), value()) for i in range(60)]
    left += [("A1", 1, 2.0), ("A1", 1, 2.0), ("A2", 2, 3.5), (None, 1, 1.0), (None, 2, 6.0)] * missing
    right = [(f"B{i}", rng.choice([1, 2, 2, None]), value()) for i in range(50)]
    right += [("B1", 2, 2.0), ("B2", 2, 3.5), (None, 1, 4.0)] * missing
    sides = [frame(rows, "id string, key int, value double").repartition(3) for rows in (left, right)]
    pairs = matrix.Pairs(*sides, near)
    scored = frame([(a, b, None if x is None or y is None else float(near(x, y))) for a, k, x in left for b, m, y in right if k == m and k is not None], "s1_id string, cand_id string, score double")
    truth = frame([(f"A{i}", f"B{rng.randrange(50)}") for i in range(60) for _ in range(5)] + [("A5", "nobody")], "s1_id string, cand_id string").distinct()
    x = decision.with_labels(decision.ranked(scored).withColumn("gap", 1 - F.col("score")), truth).cache()
    rows = x.collect()
    fine = [{"score": r["score"] or 0.0, "rank": float(r["rank"]), "gap": r["gap"] or 0.0, "y": float(r["is_match"])} for r in rows]
    ends = [cuts([r[c] for r in fine]) for c in ("score", "rank", "gap")]
    d = boosted.dealt(pairs, truth)
    assert list(boosted.quantiles(d)) == ends and (d.rows is not None) == missing
    counts = boosted.cell_counts(d, boosted.Cells(*map(np.array, ends)))
    assert counts.sum() == len(rows) and counts[..., 1].sum() == sum(r["y"] for r in fine) > 50
    binned = spark.createDataFrame([(r["s1_id"], r["cand_id"], *[float(np.searchsorted(e, f[c], "right")) for e, c in zip(ends, ("score", "rank", "gap"))], f["y"]) for r, f in zip(rows, fine)], "s1_id string, cand_id string, a double, b double, c double, y double").coalesce(1)
    binned = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(binned).cache()
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=6, maxDepth=3, maxBins=boosted.BINS, stepSize=0.1, seed=42).fit(binned)
    want = model.transform(binned).select("s1_id", "cand_id", F.round(vector_to_array("probability")[1], 6).alias("score"))
    got = boosted.tree_scores(pairs, truth, digits=6, trees=6, depth=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_pair_is_sorted_as_a_row(spark):
    from weftlink.plans import registry, views

    plan = registry.gbt_scores(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == views.view(spark, "/root/testdata/sf0.001", views.SCORED).count()
    assert boosted.tree_scores(matrix.Pairs(*[spark.createDataFrame([], "id string, key int, value double")] * 2, views.nearness), spark.createDataFrame([], "s1_id string, cand_id string")).count() == 0
