"""Incremental replica: keyed changes rewrite only the key ranges they touch.

The replica is a folder partitioned by range of an integer key.  A batch of
changes reads and rewrites the partitions that hold its keys (static partition
pruning on the read, dynamic partition overwrite on the write); all others stay
as they are, so a batch costs what it touches and not what the table holds.

A deleted row stays as a tombstone, so a partition whose rows are all deleted
is rewritten too and not left as it was.  Changes apply in ``seq`` order within a batch and
batches in order of their id; applying a batch again changes nothing, so a
batch that failed half-way is simply run again, and one that is already noted
as applied is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import materialize
from strata.streaming import apply_changes

PART, GONE = "__range", "__gone"


def _range(key: str, width: int):
    return F.floor(F.col(key) / F.lit(width)).cast("long").alias(PART)


def _applied(spark: SparkSession, path: str) -> int:
    """Greatest batch id noted as applied, -1 before any."""
    return spark.read.schema("id long").parquet(f"{path}/batches").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]


def _note(spark: SparkSession, path: str, batch_id: int) -> None:
    spark.range(batch_id, batch_id + 1, 1, 1).write.mode("append").parquet(f"{path}/batches")


def create_replica(base: DataFrame, path: str, key: str, width: int) -> None:
    """Write ``base`` as a replica of ranges of ``width`` keys; size them to a few files each."""
    rows = base.withColumn(GONE, F.lit(False)).select("*", _range(key, width))
    rows.repartition(PART).write.partitionBy(PART).parquet(f"{path}/rows")
    _note(base.sparkSession, path, -1)


def read_replica(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where(~F.col(GONE)).drop(GONE, PART)


def touched_rows(spark: SparkSession, path: str, ranges: list[int]) -> DataFrame:
    """Rows of the named ranges, tombstones included; only their folders are listed and read."""
    return spark.read.parquet(f"{path}/rows").where(F.col(PART).isin(ranges))


def apply_batch(spark: SparkSession, path: str, changes: DataFrame, key: str, width: int, seq: str, batch_id: int,
                op_col: str = "op", delete_op: str = "D") -> int:
    """Apply one batch; gives the number of ranges rewritten (0 if it was applied before)."""
    if batch_id <= _applied(spark, path):
        return 0
    changes = materialize(changes, "changes")
    ranges = [r[0] for r in changes.select(_range(key, width)).distinct().collect()]  # at most the replica's ranges
    if ranges:
        base = touched_rows(spark, path, ranges)
        live = base.where(~F.col(GONE)).drop(GONE, PART)
        new = apply_changes(live, changes, [key], seq, op_col, delete_op)
        new = new.withColumn(GONE, F.col("change") == "deleted").drop("change")
        old = base.where(F.col(GONE)).drop(PART).join(changes.select(key).distinct(), key, "left_anti")
        # a key deleted before and again has no live row: it keeps its tombstone
        again = base.where(F.col(GONE)).drop(PART).join(changes.select(key).distinct(), key, "left_semi")
        again = again.join(new.select(key), key, "left_anti")
        rows = new.unionByName(old).unionByName(again).select("*", _range(key, width))
        (rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(PART).parquet(f"{path}/rows"))
    _note(spark, path, batch_id)
    return len(ranges)


def replicate(stream: DataFrame, path: str, key: str, width: int, seq: str, checkpoint: str, available_now: bool = True):
    """Apply a stream of changes, one batch of the replica for each micro-batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch.sparkSession, path, batch, key, width, seq, batch_id)

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
