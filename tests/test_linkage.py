import heapq

import numpy as np
from pyspark.sql import functions as F

from weftlink.operators import graph, linkage


def is_s1(n):
    return n.startswith("S1")


EDGES = [("S1-a", "x", .9), ("x", "y", .9), ("S1-b", "y", .2), ("S1-b", "z", .9), ("q", "r", .5), ("S1-c", "w", .5), ("S1-d", "w", .5)]


def test_voronoi(frame):
    edges = frame(EDGES, "a string, b string, weight double")
    got = {r["cand_id"]: (r["s1_id"], round(r["distance"], 6)) for r in graph.nearest_entity(edges, is_s1).collect()}
    near, best = {}, {}
    for a, b, w in EDGES:
        near.setdefault(a, []).append((b, 1 / (w + 1e-9)))
        near.setdefault(b, []).append((a, 1 / (w + 1e-9)))
    heap = [(0.0, n, n) for n in near if n.startswith("S1")]
    while heap:
        d, s, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (s, round(d, 6))
        for m, x in near[n]:
            heapq.heappush(heap, (d + x, s, m))
    assert got == {n: v for n, v in best.items() if not n.startswith("S1")}
    assert "q" not in got and got["w"][0] == "S1-c"


def test_components(frame):
    edges = frame(EDGES, "a string, b string, weight double")
    labels = graph.components(edges)
    got = {r["node"]: r["component"] for r in labels.collect()}
    assert got["z"] == got["x"] == "S1-a" and got["q"] == got["r"] == "q"
    kinds = {r["component"]: r["kind"] for r in graph.component_classes(labels, is_s1).collect()}
    assert kinds == {"S1-a": "tangled", "S1-c": "tangled", "q": "dead"}


def test_prune(frame):
    clusters = frame([("S1-a", "x"), ("S1-b", "y")], "s1_id string, cand_id string")
    scored = frame([("S1-a", "x", .9)], "s1_id string, cand_id string, score double")
    assert [r["s1_id"] for r in graph.prune_singletons(clusters, scored, .5).collect()] == ["S1-a"]


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    m, u = np.array([.95, .9, .85, .9]), np.array([.05, .1, .2, .1])
    match = rng.random(20000) < .2
    bits = (rng.random((20000, 4)) < np.where(match[:, None], m, u)).astype(int)
    x, n = np.unique(bits, axis=0, return_counts=True)
    em, eu, prior = linkage.fit_em(x, n, tolerance=1e-7, iterations=500)
    assert np.abs(em - m).max() < .03 and np.abs(eu - u).max() < .03 and abs(prior - .2) < .02


def test_scores(frame):
    bits = frame([(1, 1), (0, 0)], "a int, b int")
    got = [r["score"] for r in linkage.score_bits(bits, ["a", "b"], {"a": .9, "b": .9}, {"a": .1, "b": .1}).orderBy(F.desc("a")).collect()]
    assert round(got[0], 6) == round(81 / 82, 6) and round(got[1], 6) == round(1 / 82, 6)


def test_forest_has_a_row_a_node(frame):
    """The edges of a task become stars, with the same components, and null ends pass."""
    rows = [(f"A{i}", f"B{j}") for i in range(30) for j in range(30)] + [("C", "D"), ("E", "E"), (None, "F")]
    got = [tuple(r) for r in graph.forest(frame(rows, "a string, b string").coalesce(1)).collect()]
    assert len(got) == 60 + 2 + 1 + 1 and len({b for _, b in got}) == len(got)
    assert {a for a, b in got if b and b[0] in "AB"} == {"A0"} and {("C", "C"), ("C", "D"), ("E", "E"), (None, "F")} <= set(got)
    labels = {r["node"]: r["component"] for r in graph.components(frame(rows[:-1], "a string, b string").withColumn("weight", F.lit(1.0))).collect()}
    assert labels == dict.fromkeys([x for r in rows[:-3] for x in r], "A0") | {"C": "C", "D": "C", "E": "E"}
