"""Scored pairs that arrive as a stream: the best entity of each candidate so far.

The state is one row for each candidate, merged batch by batch into a Parquet table of versions; a
batch that is replayed writes its version again, so results don't depend on restarts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.decision import assign
from ..sources.records import exists


def assignments(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The table after a batch, if there is one."""
    to = f"{path}/version={batch}"
    return spark.read.parquet(to) if batch >= 0 and exists(spark, to) else None


def assign_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the assignment of a stream of (s1_id, cand_id, score) under path."""
    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        old = assignments(spark, path, batch - 1)
        rows = rows.select("s1_id", "cand_id", "score")
        new = assign(rows if old is None else rows.unionByName(old.select("s1_id", "cand_id", "score")))
        new.write.mode("overwrite").parquet(f"{path}/version={batch}")
        past = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch - 2}")  # no replay needs it
        past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)

    return scored.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
