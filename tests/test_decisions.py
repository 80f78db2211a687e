import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftlink.operators import decision, metrics, splits, validate, vectors
from weftlink.sources import records, sinks

PAIR = "s1_id string, cand_id string, score double"


def pairs(df):
    return {(r["s1_id"], r["cand_id"]) for r in df.collect()}


def test_assignment(frame):
    s = frame([("A", "S2-A", .9), ("A", "X", .85), ("B", "X", .7), ("B", "S2-B", .8)], PAIR)
    assert pairs(decision.predictions(s, .6)) == {("A", "S2-A"), ("A", "X"), ("B", "S2-B")}
    ties = frame([("B", "X", .7), ("A", "X", .7)], PAIR)
    assert pairs(decision.assign(ties)) == {("A", "X")}


def test_trigger(frame):
    s = frame([("STRONG", "S2-1", .85), ("STRONG", "S3-1", .65), ("BORDER", "S2-2", .6)], PAIR)
    assert len(pairs(decision.predictions(s, .5))) == 3
    assert pairs(decision.predictions(s, .5, .7)) == {("STRONG", "S2-1"), ("STRONG", "S3-1")}


def test_f05(frame):
    truth = frame([("E1", "A"), ("E1", "B"), ("E2", "C"), ("E2", "D"), ("E4", "E")], "s1_id string, cand_id string")
    pred = frame([("E1", "A"), ("E1", "B"), ("E2", "C"), ("E4", "E"), ("E4", "F"), ("E5", "G")], "s1_id string, cand_id string")
    spine = frame([(f"E{i}",) for i in range(1, 6)], "s1_id string")
    got = {r["s1_id"]: round(r["f05"], 4) for r in metrics.entity_f05(pred, truth, spine).collect()}
    assert got == {"E1": 1.0, "E2": .8333, "E3": 1.0, "E4": .5556, "E5": 0.0}
    assert round(metrics.summary(pred, truth, spine).first()["macro_f05"], 4) == .6778


def test_sweep(frame):
    s = frame([("1", "S2-1", .92), ("1", "S2-2", .35), ("2", "S2-3", .88), ("2", "S2-4", .15), ("3", "S2-5", .2)], PAIR)
    truth = frame([("1", "S2-1"), ("2", "S2-3")], "s1_id string, cand_id string")
    spine = frame([("1",), ("2",), ("3",)], "s1_id string")
    swept = metrics.sweep(s, truth, spine, [.1, .3, .5, .7, .9])
    assert metrics.best(swept).first()["macro_f05"] == 1.0 and metrics.best(swept).first()["threshold"] == .5
    assert swept.count() == 5
    rows = decision.with_labels(s, truth).select(F.col("is_match").alias("y"), "score")
    assert metrics.roc_pr_auc(rows).first()["roc_auc"] == 1.0


def test_recall(frame):
    truth = frame([("Q1", "C1"), ("Q1", "C2"), ("Q2", "C3")], "s1_id string, cand_id string")
    got = frame([("Q1", "C1", 1), ("Q1", "X", 2), ("Q1", "Y", 3), ("Q1", "C2", 4), ("Q2", "X", 1), ("Q2", "C3", 2), ("Q3", "X", 1)], "s1_id string, cand_id string, rank int")
    r = {x["k"]: (round(x["micro"], 4), x["macro"], x["all_hits"]) for x in metrics.recall_at_k(got, truth, [1, 2, 4, 4]).collect()}
    assert r[1][:2] == (.3333, .25) and r[2][:2] == (.6667, .75) and r[4] == (1.0, 1.0, 1.0)


def test_rank_features(frame):
    cross = frame([("1", "a", 1.25), ("1", "b", .4), ("2", "c", -.15)], PAIR)
    bi = frame([("1", "a", .88, 1)], "s1_id string, cand_id string, bi_score double, rank int")
    got = {r["cand_id"]: r for r in decision.rank_features(cross, bi, frame([("1", "a")], "s1_id string, cand_id string")).collect()}
    assert got["a"]["score"] == 1.0 and got["c"]["score"] == 0.0 and got["b"]["retrieval_rank"] == 2 and got["b"]["bi_encoder_score"] == 0
    assert (got["a"]["is_match"], got["b"]["is_match"]) == (1, 0)


def test_vectors(frame):
    corpus = frame([("C1", [1., 0., 0., 0.], "US"), ("C2", [0., 1., 0., 0.], "US"), ("C3", [0., 0., 1., 0.], "IN")], "id string, v array<double>, country string")
    query = frame([("Q", [.1, .99, 0., 0.], "US"), ("R", [0., 0., 1., 0.], "FR")], "id string, v array<double>, country string")
    got = vectors.top_k(query, corpus, 2).filter("s1_id = 'Q'").orderBy("rank").collect()
    assert [r["cand_id"] for r in got] == ["C2", "C1"] and got[0]["score"] > .95
    part = pairs(vectors.top_k(query, corpus, 3, partition="country"))
    assert ("Q", "C3") not in part and ("R", "C3") in part  # an unknown partition searches everything


def test_submission(frame, spark, tmp_path):
    s = frame([("S1-1", "S2-2", .8), ("S1-1", "S2-1", .9), ("S1-1", "S2-1", .9)], PAIR)
    spine = frame([("S1-1",), ("S1-2",)], "s1_id string")
    table = sinks.matching_table(s, spine, .5)
    assert {tuple(r) for r in table.collect()} == {("S1-1", "S2-1,S2-2"), ("S1-2", "")}
    sinks.write_tsv(table, str(tmp_path / "m"))
    assert records.label_pairs(records.load_labels(spark, str(tmp_path / "m"))).count() == 2
    assert validate.validate_submission(table, spine).count() == 0
    bad = frame([("S1-1", "S2-1,S2-1,S1-9,Z-1"), ("S1-1", ""), ("S1-7", "")], "source1_entity_id string, matched_entity_ids string")
    rules = {r["rule"] for r in validate.validate_submission(bad, spine, frame([("S2-1",)], "id string")).collect()}
    assert rules == {"duplicate entity", "duplicate id in a list", "match within source 1", "unknown prefix", "missing entity", "extra entity", "unknown id"}


def test_features_contract(frame):
    assert validate.validate_features(frame([("a", "b", .5)], PAIR))[0]
    assert not validate.validate_features(frame([("a", None, 1.5)], PAIR))[0]
    assert not validate.validate_features(frame([("a", "b")], "s1_id string, cand_id string"))[0]


def test_sources(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme\t\tUS\n")
    rows = records.load_source(spark, str(tmp_path / "s.tsv"), "S1-")
    assert rows.first()["business_address"] == ""
    with pytest.raises(records.SchemaError):
        records.load_source(spark, str(tmp_path / "s.tsv"), "S2-")


def test_split(frame):
    rows = frame([(f"S1-{i}", "US" if i else "FR") for i in range(11)], "s1_id string, country string")
    got = splits.stratified_split(rows, "s1_id", ["country"]).filter("is_val").groupBy("country").count().collect()
    assert {(r["country"], r["count"]) for r in got} == {("US", 2), ("FR", 1)}


def test_pairs_made_again_give_the_same(frame):
    rows = [(f"S1-{i}", f"S2-{j}", (i * 7 + j * j * 3) % 11 / 10) for i in range(9) for j in range(i, 60)]  # many ties
    s = frame(rows, "s1_id string, cand_id string, score double")

    def same(f):
        assert sorted(map(tuple, f(False).collect())) == sorted(map(tuple, f(True).collect()))

    same(lambda again: decision.assign(s, again))
    same(lambda again: decision.predictions(s, 0.5, 0.95, again))
    same(lambda again: decision.above_or_best(s, 1.0, again))
    for k in (1, 3, 10, 100):
        same(lambda again: decision.top_k(s, k, again))


def test_scored_pairs_are_dealt_by_entity(spark):
    """Labels and bests of the scored pairs move entities: no exchange of pairs lies between their join and the result."""
    from weftlink.plans import registry, views

    sf = "/root/testdata/sf0.001"
    plan = registry._labelled(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin [s1_id" not in plan
    by_sql = spark.sql(views.SCORED.replace("FROM customer", "FROM {customer}").replace("JOIN supplier", "JOIN {supplier}"), customer=views.table(spark, sf, "customer"), supplier=views.table(spark, sf, "supplier"))
    assert by_sql.exceptAll(views.view(spark, sf, views.SCORED)).count() == 0


def test_sampled_negatives_are_the_first_in_hashed_order(frame):
    from weftlink.operators import splits

    rows = [(f"S1-{i}", f"S2-{j}", int(i == j)) for i in range(30) for j in range(30)]
    pairs = frame(rows, "s1_id string, cand_id string, is_match int")
    for ratio in (0.0, 0.5, 3.0, 28.9, 40.0):
        got = splits.sample_negatives(pairs, ratio)
        order = sorted((r for r in rows if not r[2]), key=lambda r: (hashlib.md5(f"42|{r[0]}|{r[1]}".encode()).hexdigest(), r[0], r[1]))
        assert sorted(map(tuple, got.collect())) == sorted([r for r in rows if r[2]] + order[:int(30 * ratio)])
    plan = splits.sample_negatives(pairs, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "limit=90," not in plan  # no one task holds the sample


def test_isotonic_points_have_the_weight_of_their_rows(frame):
    from weftlink.operators import models

    rows = [(0.1, 0)] * 9 + [(0.1, 1)] + [(0.2, 1)] * 2 + [(0.3, 0)] * 6 + [(0.9, 1)]
    scores = frame(rows, "score double, y int")
    got = {r["score"]: r["calibrated"] for r in models.calibrated(scores.select("score").distinct(), scores).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {0.1: 0.1, 0.2: 0.25, 0.3: 0.25, 0.9: 1.0}


def test_pairs_as_matrices(frame, monkeypatch):
    """What blocks and tiles return is what the pairs, made one by one, give; ties and null scores too."""
    import numpy as np

    from weftlink.operators import matrix

    monkeypatch.setattr(matrix, "BLOCK", 7)
    monkeypatch.setattr(matrix, "TILE", 13)
    rng = random.Random(5)
    left, right = ([(f"{s}{i}", rng.choice([1, 2, 2, None]), rng.choice([None, *range(8)])) for i in range(n)] for s, n in (("A", 40), ("B", 30)))
    near = lambda a, b: 1 - np.abs(a - b) / 8
    sides = [frame([(i, k, None if v is None else float(v)) for i, k, v in rows], "id string, key int, value double") for rows in (left, right)]
    pairs = matrix.Pairs(*sides, near)
    rows = [(a, b, None if x is None or y is None else 1 - abs(x - y) / 8) for a, k, x in left for b, m, y in right if k == m and k is not None]
    scored = frame(rows, "s1_id string, cand_id string, score double")
    same = lambda x, y: sorted(map(tuple, x.collect()), key=repr) == sorted(map(tuple, y.select(x.columns).collect()), key=repr)
    assert same(decision.above(scored, 0.8), pairs.rows(0.8))
    assert same(scored.groupBy("s1_id").agg({"score": "max"}).toDF("s1_id", "top"), pairs.tops())
    assert same(decision.top_k(scored, 5), pairs.top(5))
    k = frame([(i, n % 4) for n, (i, _, _) in enumerate(left)], "s1_id string, k int")
    assert same(decision.ranked(scored).join(k, "s1_id").filter("rank <= k").drop("k"), pairs.top(k))
    cuts = [0.5, 0.8, 0.9, 1.0]
    assert same(decision.winners(decision.contenders(scored, cuts)), decision.winners(pairs.contenders(cuts)))
    for n, c in enumerate([None, *cuts]):
        want = {(r["cand_id"], r["s1_id"]) for r in decision.assign(decision.triggered(scored, c).filter("score is not null")).collect()}
        assert {(r["cand_id"], r["s1_id"]) for r in decision.winners(pairs.contenders(cuts)).filter(f"level = {n}").collect()} == want
    truth, spine = frame([(a, b) for a, b, s in rows if s == 1.0], "s1_id string, cand_id string"), sides[0].selectExpr("id AS s1_id")
    assert same(metrics.sweep(scored, truth, spine, [.1, .8], [0.0, .1]), metrics.sweep(pairs, truth, spine, [.1, .8], [0.0, .1]))


def test_best_products_are_exact(monkeypatch):
    """Pairs are chosen in single precision, but what is returned is as all products in double precision, rounded, say."""
    import numpy as np

    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "COLUMNS", 300)
    r = np.random.default_rng(1)
    for q, c, k, d in ((r.normal(size=(50, 8)), r.normal(size=(1000, 8)), 5, 6), (r.integers(0, 2, (40, 6)) * 1.0, r.integers(0, 2, (700, 6)) * 1.0, 10, 2), (r.normal(size=(5, 4)), r.normal(size=(3, 4)), 7, 4)):
        own = np.where(np.arange(len(q)) % 3 == 0, np.minimum(np.arange(len(q)), len(c) - 1), -1)
        s = np.round(q @ c.T, d)
        s[own >= 0, own[own >= 0]] = -np.inf
        a, b, _ = vectors._best(q, c, own, k, d)
        for i in range(len(q)):
            assert b[a == i].tolist() == [j for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] > -np.inf]
