"""Stream queries.

Every windowed query is one function that works on a batch DataFrame *and*
on a streaming DataFrame (Structured Streaming), so the batch result is the
oracle for the stream result.  An endless stream takes an event-time watermark
(a parameter: it bounds the window state and drops later rows, which
``run_to_completion`` counts); draining a stored table takes none, so no row
is lost in any order of files and micro-batches; because append mode withholds the last open
windows, the runners emit in *update* mode through ``foreachBatch`` and
upsert by window into the sink (the latest emission of a window wins).

State and checkpoints live under ``spark.checkpoint.dir`` (shared storage on
a cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.functions import units
from strata.session import checkpoint_dir

BATCH = "batch_id"


# ------------------------------------------------------------------ T3-T8 (batch or stream)
def _window(ts: str, duration: str) -> Column:
    return F.window(F.col(ts), duration)


def _watermarked(df: DataFrame, ts: str, watermark: str | None) -> tuple[DataFrame, bool]:
    """Apply the watermark; event time without zone (``timestamp_ntz``) is
    read as UTC for the watermark and the window start is converted back."""
    if not watermark:
        return df, False
    ntz = dict(df.dtypes).get(ts) == "timestamp_ntz"
    src = df.withColumn(ts, F.col(ts).cast("timestamp")) if ntz else df
    return src.withWatermark(ts, watermark), ntz


def _start(ntz: bool) -> Column:
    s = F.col("w.start")
    return (s.cast("timestamp_ntz") if ntz else s).alias("window_start")


def tumbling_count(df: DataFrame, ts: str, duration: str = "1 minute", name: str = "records",
                   watermark: str | None = None) -> DataFrame:
    """Records per tumbling window of ``ts``."""
    src, ntz = _watermarked(df, ts, watermark)
    return (src.groupBy(_window(ts, duration).alias("w"))
            .agg(F.count(F.lit(1)).alias(name))
            .select(_start(ntz), name))


def tumbling_avg(df: DataFrame, ts: str, c: str, duration: str = "5 minutes", scale: int | None = 2,
                 watermark: str | None = None) -> DataFrame:
    """T4: signal average per tumbling window (exact mean when ``scale`` is given)."""
    src, ntz = _watermarked(df, ts, watermark)
    mean = (F.sum(units(c, scale)) / F.lit(float(10 ** scale)) / F.count(c)) if scale is not None else F.avg(c)
    return (src.groupBy(_window(ts, duration).alias("w"))
            .agg(mean.alias(f"avg_{c}"), F.count(F.lit(1)).alias("n"))
            .select(_start(ntz), f"avg_{c}", "n"))


def group_signal(df: DataFrame, key: str, c: str, k: int | None = 20, scale: int | None = 2) -> DataFrame:
    """T5: average and max of the signal per group, highest average first, top k."""
    mean = (F.sum(units(c, scale)) / F.lit(float(10 ** scale)) / F.count(c)) if scale is not None else F.avg(c)
    out = df.groupBy(key).agg(mean.alias(f"avg_{c}"), F.max(c).alias(f"max_{c}"))
    out = out.orderBy(F.col(f"avg_{c}").desc(), F.col(key).asc())
    return out.limit(k) if k is not None else out


def group_stats(df: DataFrame, key: str, c: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(c).alias("avg_val"), F.stddev(c).alias("stdev_val"))


def sigma_outliers(df: DataFrame, key: str, c: str, k: float = 3.0, stats: DataFrame | None = None,
                   limit: int | None = None) -> DataFrame:
    """Rows above group mean + k·stddev, joined to their group stats.

    ``stats`` may be a static table (stream-static join for a streaming
    ``df``); by default it is computed from ``df`` itself (batch).
    """
    from strata.session import materialize

    # written first, so that AQE can split a hot key at the join
    st = stats if stats is not None else materialize(group_stats(df, key, c), "group-stats")
    out = (df.join(st, key, "inner")
           .filter(F.col(c) > F.col("avg_val") + F.lit(k) * F.col("stdev_val"))
           .select(key, c, "avg_val", "stdev_val"))
    return out.limit(limit) if limit is not None else out


def latest_n(df: DataFrame, ts: str, n: int = 100, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Most recent n rows (a top-k: per-task top n, then merge)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in tiebreak]).limit(n)


def store_count(df: DataFrame) -> DataFrame:
    """Row count of the store."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


# ------------------------------------------------------------------ T10 / T11
def apply_changes(base: DataFrame, changes: DataFrame, key: Sequence[str], seq: str,
                  op_col: str = "op", delete_op: str = "D") -> DataFrame:
    """Apply keyed changes to a replica and report what happened per key.

    ``changes`` holds ``key + [seq, op] + value columns`` (a subset of the
    base columns; NULL means "unchanged").  Changes apply in ``seq`` order:
    each value column takes its last non-NULL change, so two changes of
    different columns of one key both count; a delete forgets the row, and a
    change behind it starts a new row whose other columns are NULL.  Equal
    ``seq``: a delete comes first, then the greater value.

    One partial aggregate per key (no per-key sort).  Output = base columns +
    ``change`` in {'unchanged', 'updated', 'inserted', 'deleted'}; deleted
    rows are kept with their old values so the caller can report them, and
    are dropped by ``current_rows``.
    """
    key = list(key)
    val_cols = [c for c in changes.columns if c not in key and c not in (seq, op_col)]
    dropped = F.col(op_col) == delete_op
    at = F.col(seq)
    ch = changes.groupBy(*key).agg(
        F.max(F.when(dropped, at)).alias("__deleted_at"),
        F.max(F.when(~dropped, at)).alias("__changed_at"),
        *[F.max(F.when(~dropped & F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"__last_{c}")
          for c in val_cols]).withColumn("__in_changes", F.lit(True))
    j = base.withColumn("__in_base", F.lit(True)).join(ch, key, "full_outer")
    gone = F.col("__deleted_at").isNotNull() & (F.col("__changed_at").isNull() | (F.col("__changed_at") < F.col("__deleted_at")))
    again = F.col("__deleted_at").isNotNull() & ~gone
    cols = []
    for c in base.columns:
        if c in key:
            cols.append(F.col(c))
            continue
        new = F.lit(None)
        if c in val_cols:
            last = F.col(f"__last_{c}")
            new = F.when(F.col("__deleted_at").isNull() | (last["at"] >= F.col("__deleted_at")), last["v"])
        cols.append(F.when(gone, F.col(c)).when(again, new).otherwise(F.coalesce(new, F.col(c))).alias(c))
    change = (F.when(F.col("__in_changes").isNull(), F.lit("unchanged"))
              .when(gone, F.when(F.col("__in_base").isNull(), F.lit("noop")).otherwise(F.lit("deleted")))
              .when(F.col("__in_base").isNull(), F.lit("inserted"))
              .otherwise(F.lit("updated")))
    return j.select(*cols, change.alias("change")).filter(F.col("change") != "noop")


def current_rows(applied: DataFrame) -> DataFrame:
    return applied.filter(F.col("change") != "deleted").drop("change")


def replica_diff(a: DataFrame, b: DataFrame, key: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Rows that differ between a source and its replica.

    Full outer join on the key; columns compared null-safely, numeric ones
    within ``tol``.  ``diff`` is 'missing_in_replica', 'extra_in_replica' or
    the comma-separated list of mismatching columns.
    """
    from pyspark.sql.types import NumericType

    key = list(key)
    num = {f.name for f in a.schema.fields if isinstance(f.dataType, NumericType)}
    others = [c for c in a.columns if c not in key and c in b.columns]
    aa = a.select(*key, *[F.col(c).alias(f"__a_{c}") for c in others], F.lit(True).alias("__a"))
    bb = b.select(*key, *[F.col(c).alias(f"__b_{c}") for c in others], F.lit(True).alias("__b"))
    j = aa.join(bb, key, "full_outer")
    mism = []
    for c in others:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        if c in num and tol > 0:
            same = (x.isNull() & y.isNull()) | (F.abs(x - y) <= F.lit(tol))
            same = F.coalesce(same, F.lit(False))
        else:
            same = x.eqNullSafe(y)
        mism.append(F.when(~same, F.lit(c)))
    diff = (F.when(F.col("__b").isNull(), F.lit("missing_in_replica"))
            .when(F.col("__a").isNull(), F.lit("extra_in_replica"))
            .otherwise(F.concat_ws(",", *mism)))
    return (j.select(*key, diff.alias("diff")).filter(F.col("diff") != ""))


# ------------------------------------------------------------------ stream runners
def _scratch(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Streaming file source over a landing folder (new files = new rows)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def stream_append(stream_df: DataFrame, sink_path: str, checkpoint: str | None = None,
                  fmt: str = "parquet", available_now: bool = True):
    """Append a stream of typed events into a table path (exactly once via
    the sink's commit log + checkpoint)."""
    spark = stream_df.sparkSession
    ck = checkpoint or _scratch(spark, "ckpt-append")
    w = stream_df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink_path)


def upsert_windows(stream_agg: DataFrame, sink_path: str, keys: Sequence[str], checkpoint: str | None = None,
                   available_now: bool = True):
    """Run a windowed aggregate in update mode; each micro-batch's changed
    windows go to a folder of the batch id, written anew if the batch is
    retried, and ``read_upserted`` keeps the latest emission per window key."""
    spark = stream_agg.sparkSession
    ck = checkpoint or _scratch(spark, "ckpt-upsert")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/{BATCH}={batch_id}")

    w = stream_agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_upserted(spark: SparkSession, sink_path: str, keys: Sequence[str]) -> DataFrame:
    from strata.operators.windows import latest_by

    df = spark.read.parquet(sink_path)
    cols = [c for c in df.columns if c != BATCH]
    return latest_by(df.select(BATCH, *cols), keys, [BATCH]).select(*cols)


def alert_stream(stream_df: DataFrame, predicate: Column, sink_path: str, cols: Sequence[str] | None = None,
                 checkpoint: str | None = None, available_now: bool = True):
    """Stateless alert feed — the filtered rows of each micro-batch in a
    folder of its id, so that a retried batch does not add its rows twice."""
    spark = stream_df.sparkSession
    ck = checkpoint or _scratch(spark, "ckpt-alert")
    feed = stream_df.filter(predicate)
    if cols:
        feed = feed.select(*cols)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/{BATCH}={batch_id}")

    w = feed.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", ck)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_alerts(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.parquet(sink_path).drop(BATCH)


def run_to_completion(q) -> int:
    """Wait, however long it takes, for an ``availableNow`` query to drain its
    input; gives the number of late rows that its watermark dropped."""
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)


__all__ = [n for n in dir() if not n.startswith("_")]
