"""Running statistics of streams: top groups (T5) and sigma outliers.

T5 keeps every group's sums in the stream's state and writes the whole top-k of
each micro-batch (complete output mode); readers take the newest.

T6 needs each group's mean and deviation.  A first stream folds every
micro-batch into count, mean and sum of squared deviations of its groups; parts
of different batches merge exactly (parallel variance), so nothing is read
twice and a retried batch replaces its own part.  A second stream joins its
rows with the merged statistics (a stream-static join) and writes the outliers.
Run behind the first, it gives what the batch form gives; run beside it, each
micro-batch is judged by the statistics of the batches folded so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import units
from strata.streaming import BATCH, group_signal, sigma_outliers


def _start(writer, available_now: bool):
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


# ------------------------------------------------------------------ T5
def top_groups_stream(stream: DataFrame, key: str, c: str, sink: str, checkpoint: str, k: int = 20,
                      scale: int | None = 2, available_now: bool = True):
    """Each micro-batch writes the k groups of highest average so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    top = group_signal(stream, key, c, k, scale)
    return _start(top.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def read_newest(spark: SparkSession, sink: str) -> DataFrame:
    """Rows of the last micro-batch written; only its folder is read."""
    last = spark.read.parquet(sink).agg(F.max(BATCH)).first()[0]
    return spark.read.parquet(sink).where(F.col(BATCH) == last).drop(BATCH)


# ------------------------------------------------------------------ T6
def moments(df: DataFrame, key: str, c: str, scale: int | None = None) -> DataFrame:
    """key, n, mean, m2 (sum of squared deviations), total of the non-null
    values; with ``scale`` the total is in exact units of so many decimals."""
    total, unit = (F.sum(c), 1.0) if scale is None else (F.sum(units(c, scale)), float(10 ** scale))
    return df.groupBy(key).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"),
                               total.alias("total"), F.lit(unit).alias("unit")).where("n > 0")


def merge_moments(parts: DataFrame, key: str) -> DataFrame:
    """One row a key of several parts: with d the distance of a part's mean
    from the first part's, squares add up as m2 + n d^2 less the whole's n d^2.
    One aggregate; taking distances keeps large means from cancelling."""
    first = F.min_by("mean", BATCH).alias("at")
    near = parts.groupBy(key).agg(first)
    x = parts.join(near, key).withColumn("d", F.col("mean") - F.col("at"))
    x = x.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("nd"),
                           F.sum("total").alias("total"), F.first("unit").alias("unit"),
                           F.sum(F.col("m2") + F.col("n") * F.col("d") * F.col("d")).alias("q"))
    return x.select(key, "n", (F.col("total") / F.col("unit") / F.col("n")).alias("mean"),
                    F.greatest(F.col("q") - F.col("nd") * F.col("nd") / F.col("n"), F.lit(0.0)).alias("m2"), "total", "unit")


def moments_stream(stream: DataFrame, key: str, c: str, sink: str, checkpoint: str, scale: int | None = None,
                   available_now: bool = True):
    """Fold each micro-batch into the parts under ``sink``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        moments(batch, key, c, scale).write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    return _start(stream.select(key, c).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def merge_parts(spark: SparkSession, sink: str, key: str, into: str) -> None:
    """Merge all parts into one written part (an endless stream's parts would
    grow in number); readers then use ``into`` as the only part."""
    merged = merge_moments(spark.read.parquet(sink), key)
    merged.write.mode("overwrite").parquet(f"{into}/{BATCH}=0")


def stats_of(parts: DataFrame, key: str) -> DataFrame:
    """key, avg_val, stdev_val (sample; null for a single value) from merged parts."""
    m = merge_moments(parts, key)
    return m.select(key, F.col("mean").alias("avg_val"),
                    F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("stdev_val"))


def sigma_stream(stream: DataFrame, parts_path: str, key: str, c: str, sink: str, checkpoint: str, k: float = 3.0,
                 available_now: bool = True):
    """Outliers of each micro-batch against the statistics folded so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stats = stats_of(batch.sparkSession.read.parquet(parts_path), key)
        sigma_outliers(batch, key, c, k, stats=stats).write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    return _start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)
