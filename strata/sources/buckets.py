"""Tables bucketed by a join key, written once.

Two tables with the same number of buckets of one key join, and aggregate by
that key, without any shuffle.  A bucket is read by one task, so a key that
holds a large share of the rows would make one task carry them all; rows per
bucket are therefore counted when the table is written:

* a bucket far above the mean is written by several tasks, dealt by a salt;
* a table with such a bucket is read as plain files, not by buckets, and its
  joins shuffle, where AQE splits the key.  Rows are the same either way.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.sources.versions import built_once

SKEW_FACTOR, SKEW_BYTES = 5, 256 << 20  # of a bucket against the mean, and in all (as AQE's skew join)


def write_bucketed(df: DataFrame, at: str, keys: Sequence[str], buckets: int, skew_factor: int = SKEW_FACTOR) -> dict:
    """Write ``df`` below ``at`` as ``buckets`` buckets of ``keys``; gives what a reader has to know.

    The counts by bucket, ``buckets`` rows, are all that reaches the driver."""
    spark = df.sparkSession
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))  # the hash that Spark's bucketed tables use
    df.write.parquet(f"{at}/rows")  # counted and written from the same rows
    rows = spark.read.schema(df.schema).parquet(f"{at}/rows")
    sizes = {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    mean = max(total / buckets, 1)
    parts = {b: -(-n // int(mean)) for b, n in sizes.items() if n > skew_factor * mean}
    # a task for each bucket (hashed bucket numbers would put several into one), and more for the large ones
    task, tasks = bucket, buckets
    for b, n in parts.items():  # fewer than buckets / skew_factor
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(n))
        task = F.when((bucket == b) & (salt > 0), salt + F.lit(tasks - 1)).otherwise(task)
        tasks += n - 1
    name = f"strata_writing_{at.rsplit('/', 1)[-1]}"
    (rows.repartitionById(tasks, task.cast("int")).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", f"{at}/table").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files of a table with a path of its own stay
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/table")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(p).getLength()
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/rows")
    fs.delete(old, True)
    largest = max(sizes.values(), default=0)
    return {"keys": list(keys), "buckets": buckets, "schema": df.schema.json(), "hot": bool(parts),
            "largest_bytes": size * largest // max(total, 1)}


def read_bucketed(spark: SparkSession, name: str, info: dict, skew_bytes: int = SKEW_BYTES) -> DataFrame:
    """The table by its buckets, or as plain files where one bucket is too large for a task."""
    folder, schema = f"{info['at']}/table", StructType.fromJson(json.loads(info["schema"]))
    if info["hot"] and info["largest_bytes"] > skew_bytes:
        return spark.read.schema(schema).parquet(folder)
    if not spark.catalog.tableExists(name):  # files of another session: only the catalog has to learn of them
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{k}`" for k in info["keys"])
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {info['buckets']} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def bucketed_once(spark: SparkSession, name: str, version: str, make, keys: Sequence[str], buckets: int,
                  base: str, skew_bytes: int = SKEW_BYTES) -> DataFrame:
    """``make()`` bucketed by ``keys``, written once per version and layout."""
    folder = f"{base.rstrip('/')}/{name}/{version}-{'-'.join(keys)}-{buckets}"
    info = built_once(spark, folder, lambda at: write_bucketed(make(), at, keys, buckets))
    return read_bucketed(spark, f"{name}_{info['at'].rsplit('/', 1)[-1]}", info, skew_bytes)
