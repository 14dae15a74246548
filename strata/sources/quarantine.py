"""Quarantine ingest of JSON text (T2, S17, S21), batch or stream.

Each line is parsed once with a declared schema in PERMISSIVE mode.  A line
that does not parse, or whose fields do not have their types, or that lacks a
required field, goes with its reason and its text to a table of rejected rows;
nothing is dropped.  Good rows carry typed columns and an event time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from strata.session import checkpoint_dir

RAW, REASON, BATCH = "raw", "reason", "batch_id"


def parse_lines(df: DataFrame, schema: StructType | str, required: Sequence[str] = (), text_col: str = "value") -> DataFrame:
    """raw, the schema's columns, and reason: null for a good row, else
    'malformed', 'type:<first field of another type>' or 'missing:<field>'."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = F.col(text_col)
    # all fields as text tell a field of the wrong type from a line that is no JSON
    loose = StructType([type(f)(f.name, StringType()) for f in fields] + [type(fields[0])("__bad", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    rows = df.select(text.alias(RAW), F.from_json(text, loose, options).alias("__s"))
    typed = [F.col(f"__s.{f.name}").try_cast(f.dataType).alias(f.name) for f in fields]
    broken = F.col("__s").isNull() | F.col("__s.__bad").isNotNull() | F.col(RAW).isNull() | (F.trim(RAW) == "")
    reason: Column = F.when(broken, F.lit("malformed"))
    for f in fields:
        given = F.col(f"__s.{f.name}").isNotNull()
        reason = reason.when(given & F.col(f"__s.{f.name}").try_cast(f.dataType).isNull(), F.lit(f"type:{f.name}"))
    for name in required:
        reason = reason.when(F.col(f"__s.{name}").isNull(), F.lit(f"missing:{name}"))
    return rows.select(RAW, *typed, reason.alias(REASON))


def split_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones as (raw, reason)."""
    return parsed.where(F.col(REASON).isNull()).drop(RAW, REASON), parsed.where(F.col(REASON).isNotNull()).select(RAW, REASON)


def quarantine_stream(lines: DataFrame, schema: StructType | str, sink: str, required: Sequence[str] = (),
                      checkpoint: str | None = None, available_now: bool = True):
    """The same on a stream of text lines: ``sink/good`` and ``sink/rejected``
    get a folder of each batch's id, written anew if the batch is retried."""
    ck = checkpoint or f"{sink.rstrip('/')}/_checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two writes of one parse
        try:
            for name, part in zip(("good", "rejected"), split_rows(batch), strict=True):
                part.write.mode("overwrite").parquet(f"{sink}/{name}/{BATCH}={batch_id}")
        finally:
            batch.unpersist()

    checkpoint_dir(lines.sparkSession)
    w = parse_lines(lines, schema, required).writeStream.foreachBatch(write).option("checkpointLocation", ck)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_quarantine(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{sink}/{name}").drop(BATCH) for name in ("good", "rejected"))
