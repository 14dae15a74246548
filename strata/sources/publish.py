"""Atomic publication of tables.

A published table is a catalog view over one versioned folder.  A refresh or
compaction writes a whole new folder first and then replaces the view, which
is a single change in the catalog: a reader sees the old version or the new
one, never a mixture, and a failed write leaves nothing behind that is read.
The schema belongs to the version, so columns may be added, dropped or
retyped.  A plan made before the switch goes on reading its own folder, which
``expire`` deletes later.

Two writers: each names the version it started from; the second to finish
finds another one current and raises ``Conflict`` instead of undoing the
first one's work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

VERSIONS = "strata.versions"  # view property: folders, newest first


class Conflict(RuntimeError):
    """Another version was published meanwhile."""


def versions(spark: SparkSession, name: str) -> list[str]:
    """Folders of a published table, newest (the current one) first; none if it is not published."""
    if not spark.catalog.tableExists(name):
        return []
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return props[VERSIONS].split("|") if VERSIONS in props else []


def _point(spark: SparkSession, name: str, folders: Sequence[str]) -> None:
    listed = "|".join(folders).replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{VERSIONS}' = '{listed}') "
              f"AS SELECT * FROM parquet.`{folders[0]}`")


def publish(df: DataFrame, name: str, base: str, partition_by: Sequence[str] = (), started_from: str | None = "",
            write: Callable[[str], None] | None = None) -> str:
    """Full refresh of ``name``; gives the new folder.

    ``started_from`` is the version that ``df`` was made from (None: not yet
    published); by default the one current when the write begins.
    ``write`` writes ``df`` to the folder that it is given."""
    spark = df.sparkSession
    before = versions(spark, name)
    if started_from == "":
        started_from = before[0] if before else None
    folder = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    (write or w.parquet)(folder)
    now = versions(spark, name)
    if (now[0] if now else None) != started_from:
        _delete(spark, folder)
        raise Conflict(f"{name} is at {now[0] if now else 'no version'}, not at {started_from}")
    _point(spark, name, [folder, *now])
    return folder


def compact_published(spark: SparkSession, name: str, base: str, sort_cols: Sequence[str] = (),
                      file_bytes: int = 512 << 20) -> str:
    """Rewrite the current version into files of about ``file_bytes`` and switch to it."""
    from strata.sources import write_sized

    current = versions(spark, name)[0]
    df = spark.read.parquet(current)
    return publish(df, name, base, started_from=current, write=lambda folder: write_sized(df, folder, sort_cols, file_bytes))


def rollback(spark: SparkSession, name: str) -> str:
    """Point at the version before the current one."""
    now = versions(spark, name)
    if len(now) < 2:
        raise ValueError(f"{name} has no earlier version")
    _point(spark, name, now[1:])
    return now[1]


def expire(spark: SparkSession, name: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` versions, once no plan reads them any more."""
    now = versions(spark, name)
    old = now[max(keep, 1):]
    if old:
        _point(spark, name, now[:max(keep, 1)])  # first out of the list, then off the disk
        for folder in old:
            _delete(spark, folder)
    return old


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
