"""Weighted undirected graphs as edge tables (a, b, weight).

Iterations write their state to the checkpoint folder, so no plan grows and a lost executor costs
one round; the number of rounds is that of the longest shortest path in hops.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decision import with_labels


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one of this machine, which only a
    local master (as in tests) may use."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark._weft_graph = getattr(spark, "_weft_graph", None) or tempfile.mkdtemp(prefix="weft-graph-")
    return spark._weft_graph


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its files go when the driver's JVM ends."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/weft-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def build(scored: DataFrame, candidate_edges: DataFrame, least: float = 0.10) -> DataFrame:
    """Entity-candidate edges from `least` on, and candidate-candidate edges."""
    return scored.filter(F.col("score") >= least).select(F.col("s1_id").alias("a"), F.col("cand_id").alias("b"), F.col("score").alias("weight")).unionByName(candidate_edges.select("a", "b", "weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


#: Edges after which a task joins those it holds, and stars beyond which it lets them go.
HELD = 1 << 20


def _stars(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    """Each node with the least of its component."""
    nodes = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    x, y = np.split(rank[nodes.indices.to_numpy()], 2)
    label = np.arange(len(order))
    while True:
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    names = nodes.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([names.take(pa.array(label)), names], ["a", "b"])


def forest(edges: DataFrame) -> DataFrame:
    """(a, b) with the same nodes and components: the edges of a task as stars, one row for each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            none = pc.or_(batch.column(0).is_null(), batch.column(1).is_null())
            if none.true_count:
                yield batch.filter(none)
                batch = batch.filter(pc.invert(none))
            held, n = held + [batch], n + batch.num_rows
            if n >= HELD:
                held = [_stars(*(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1)))]
                n = 0
                if held[0].num_rows > 4 * HELD:
                    yield held.pop()
        if held:
            yield _stars(*(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1)))

    rows = edges.select("a", "b")
    return rows.mapInArrow(run, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached; the edges of each task are joined to stars first,
    then least labels spread with pointer jumping."""
    stars = checkpointed(forest(edges))
    both = checkpointed(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("n2"), F.col("component").alias("further"))
        step = checkpointed(step.join(jump, F.col("c") == F.col("n2"), "left").select("node", "old", F.least("c", F.coalesce("further", "c")).alias("component")))
        labels = step.select("node", "component")
        if not step.filter("old <> component").limit(1).count():
            return labels


def component_classes(labels: DataFrame, is_entity) -> DataFrame:
    """component, entities, nodes, kind: dead (no entity), clean (one) or tangled."""
    by = labels.groupBy("component").agg(F.sum(is_entity(F.col("node")).cast("long")).alias("entities"), F.count("*").alias("nodes"))
    return by.withColumn("kind", F.when(F.col("entities") == 0, "dead").when(F.col("entities") == 1, "clean").otherwise("tangled"))


def nearest_entity(edges: DataFrame, is_entity) -> DataFrame:
    """(s1_id, cand_id, distance): each candidate's nearest entity, an edge being 1 / (weight + 1e-9) long.

    All entities start at once; a round relaxes the edges of nodes whose distance fell.  Ties go to the lesser entity."""
    both = checkpointed(symmetric(edges).groupBy("a", "b").agg(F.min(1 / (F.col("weight") + 1e-9)).alias("length")))
    start = both.select(F.col("a").alias("node")).distinct().filter(is_entity(F.col("node")))
    best = checkpointed(start.select("node", F.struct(F.lit(0.0).alias("d"), F.col("node").alias("s")).alias("at")))
    front = best
    while front.limit(1).count():
        reached = front.join(both, F.col("node") == F.col("a")).groupBy("b").agg(F.min(F.struct((F.col("at.d") + F.col("length")).alias("d"), F.col("at.s").alias("s"))).alias("new"))
        reached = reached.filter(~is_entity(F.col("b")))
        all_ = best.join(reached, F.col("node") == F.col("b"), "full")
        better = F.col("new").isNotNull() & (F.col("at").isNull() | (F.col("new") < F.col("at")))
        both_rows = checkpointed(all_.select(F.coalesce("node", "b").alias("node"), F.when(better, F.col("new")).otherwise(F.col("at")).alias("at"), F.coalesce(better, F.lit(False)).alias("moved")))
        best, front = both_rows.select("node", "at"), both_rows.filter("moved").select("node", "at")
    return best.filter(~is_entity(F.col("node"))).select(F.col("at.s").alias("s1_id"), F.col("node").alias("cand_id"), F.col("at.d").alias("distance"))


def cluster_scores(clusters: DataFrame, scored: DataFrame) -> DataFrame:
    """s1_id, best: the largest direct score within a cluster, a missing edge being 0."""
    mine = with_labels(scored.select("s1_id", "cand_id", "score"), clusters).filter("is_match = 1").drop("is_match")
    return clusters.join(mine, ["s1_id", "cand_id"], "left").groupBy("s1_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("best"))


def prune_singletons(clusters: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Clusters whose best direct score reaches the threshold."""
    return clusters.join(cluster_scores(clusters, scored).filter(F.col("best") >= threshold).select("s1_id"), "s1_id", "left_semi")
