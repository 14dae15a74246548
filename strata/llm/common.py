"""Helpers shared by the operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, a null text as empty; any other column of the
    input, whatever its name, is left behind before work columns are added."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c == "text" else F.col(c)
                       for c in cols])


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` maps the dictionary of a batch's columns to one of the result's.

    Batches hold a bounded number of rows and bytes, so a task's memory does
    not grow with the table."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                out = fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)})
                yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in fields}, schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


class Scratch:
    """Tables written once in the shared checkpoint folder and read again:
    they cut lineage, survive lost executors and are not computed twice."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no plan needs any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"{self.path.rpartition('/')[2]}/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def shared(spark: SparkSession, thing) -> Callable:
    """Broadcast an object of bounded size; a task calls the result to get it.

    It is pickled by value, so workers need no copy of the repository."""
    sent, here = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), []

    def get():
        if not here:
            here.append(pickle.loads(sent.value))
        return here[0]

    return get
