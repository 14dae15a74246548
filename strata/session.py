"""Session construction and cluster-facing settings.

The library never hard-codes a cluster size.  Settings that matter at scale:

* AQE on, with partition coalescing and skew-join splitting, so shuffle sizes
  are re-planned from runtime statistics (a key holding a third of the rows is
  split across tasks on the join side that carries it).
* ``spark.sql.adaptive.autoBroadcastJoinThreshold`` decides broadcasts from
  *measured* shuffle sizes; explicit ``broadcast()`` is only used for
  dimensions whose cardinality is fixed by definition (nation, region).
* ANSI mode stays on; operators use ``try_*`` functions where the reference
  expects NULL instead of an error.
* Lineage is cut through ``spark.checkpoint.dir`` (a shared folder on a
  cluster).  It is read from the session; only tests set their own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "strata", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``shuffle_partitions`` defaults to ``$STRATA_SHUFFLE_PARTITIONS`` or 8 for
    local runs; on a cluster pass a value sized to ~128 MB per partition of
    the largest shuffle (AQE coalesces downwards from there).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or int(os.environ.get("STRATA_SHUFFLE_PARTITIONS", "0"))
    if not parts:
        if master and not master.startswith("local"):
            raise ValueError("on a cluster, give shuffle_partitions or STRATA_SHUFFLE_PARTITIONS: AQE only "
                             "coalesces downward from it")
        parts = 8
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(parts)
    conf["spark.driver.memory"] = os.environ.get("STRATA_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is set by the
    deployment.  Only when it is unset (local tests) do we create a scratch
    folder; it is registered on the context so ``DataFrame.checkpoint()``
    and streaming checkpoints use it.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not cur:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "(checkpoints, stream state and intermediate layers are written there)")
        global _LOCAL_CKPT
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="strata-ckpt-")
        cur = _LOCAL_CKPT
        try:
            spark.conf.set("spark.checkpoint.dir", cur)
        except Exception:  # noqa: BLE001 — static conf on some deployments
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cur)
    return cur


_LOCAL_CKPT: str | None = None


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, kind: str = "mat"):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back.

    Used where a plan forks over an expensive input (a deduplicated or
    aggregated table read by two branches): Catalyst prunes each branch
    differently, so the branches would not share an exchange and the input
    would be computed twice.  The written copy has file statistics (AQE can
    broadcast it if it is small) and survives executor loss.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def drop_intermediates(spark) -> int:
    """Delete what ``materialize`` wrote in this application.  The application
    owns these copies: call it once no plan that reads them is still to run."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
