"""Sources, sinks and ingest helpers.

Reads go through ``spark.read`` so filters and projections push into the
scan; writes are ``DataFrameWriter`` calls (parquet tables — no Delta jar).
Nothing here collects rows to the driver; statistics (S14, S15, S19) are
single aggregate jobs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.operators.quality import cast_cols

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


# ------------------------------------------------------------------ S1/S2/S17
def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
             date_cols: Mapping[str, str | None] | None = None, on_bad: str = "permissive",
             sep: str = ",") -> DataFrame:
    """CSV scan with header.

    * no ``schema`` → inferred (S1; one extra pass over the files — avoid on
      large inputs);
    * ``schema`` → declared, no inference pass (S2);
    * ``date_cols`` → ``{col: format}`` parsed after the read (S2);
    * ``on_bad='drop'`` → malformed rows are skipped (S17, needs a schema).
    """
    r = spark.read.option("header", True).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    if on_bad == "drop":
        r = r.option("mode", "DROPMALFORMED")
    elif on_bad == "fail":
        r = r.option("mode", "FAILFAST")
    df = r.csv(path)
    if date_cols:
        df = df.withColumns({c: (F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)) if fmt
                                 else F.try_to_timestamp(F.col(c).cast("string"))).cast("date")
                             for c, fmt in date_cols.items()})
    return df


def bronze_stamp(df: DataFrame, batch_id: str | None = None, file_col: str | None = "source_file",
                 ts_col: str = "ingestion_timestamp", batch_col: str = "batch_id") -> DataFrame:
    """S3: ingestion time, source file (``_metadata.file_path``) and batch id."""
    new: dict[str, Column] = {ts_col: F.current_timestamp()}
    if file_col:
        new[file_col] = F.col("_metadata.file_path")
    if batch_id is not None:
        new[batch_col] = F.lit(batch_id)
    return df.withColumns(new)


# ------------------------------------------------------------------ S4-S8
def read_table(spark: SparkSession, name: str) -> DataFrame:
    """S4."""
    return spark.table(name)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                overwrite_schema: bool = True, fmt: str = "parquet") -> None:
    """Full-refresh write as a managed table, replaced with its schema
    (``overwrite_schema=False`` raises where the schema would change).  Readers
    see the table missing while it is replaced; ``publish`` has no such gap."""
    spark = df.sparkSession
    if mode == "overwrite" and not overwrite_schema and spark.catalog.tableExists(name):
        old = [(f.name, f.dataType) for f in spark.table(name).schema]
        if sorted(old, key=str) != sorted([(f.name, f.dataType) for f in df.schema], key=str):
            raise ValueError(f"the schema of {name} would change")
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def append_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Append, creating the table if it does not exist."""
    df.write.mode("append").format(fmt).saveAsTable(name)


def write_path(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
               fmt: str = "parquet") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_path(spark: SparkSession, path: str, fmt: str = "parquet",
              schema: StructType | None = None) -> DataFrame:
    """Path-addressed lake table read."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def load_tables(spark: SparkSession, sf_dir: str, names: Sequence[str] = DRIVER_TABLES,
                register: bool = True) -> dict[str, DataFrame]:
    """Read ``{sf_dir}/{name}.parquet`` for each name (and register temp views)."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        if register:
            df.createOrReplaceTempView(n)
        out[n] = df
    return out


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               properties: Mapping[str, str] | None = None) -> None:
    """JDBC append load (batched by the JDBC writer per partition)."""
    df.write.jdbc(url, table, mode=mode, properties=dict(properties or {}))


def read_jdbc(spark: SparkSession, url: str, query: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """JDBC read of a table or a pushed-down subquery.

    ``query`` may be a table name or ``(SELECT ...) t``; a partition column
    with bounds splits the read into parallel range queries.
    """
    props = dict(properties or {})
    if partition_column:
        return spark.read.jdbc(url, query, column=partition_column, lowerBound=lower,
                               upperBound=upper, numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, query, properties=props)


# ------------------------------------------------------------------ S9/S10
def run_spec_query(spark: SparkSession, spec: Mapping) -> DataFrame:
    """Register the spec's tables as views, then run its SQL.

    ``spec = {"tables": {view: path | DataFrame}, "format": "parquet", "sql": "..."}``.
    """
    fmt = spec.get("format", "parquet")
    for view, src in spec["tables"].items():
        df = src if isinstance(src, DataFrame) else spark.read.format(fmt).load(src)
        df.createOrReplaceTempView(view)
    return spark.sql(spec["sql"])


def create_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """Create-or-replace reporting view (expanded at read time)."""
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")
    return spark.table(name)


# ------------------------------------------------------------------ S11
def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files a stored table is read from, by the planner's count."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """Bytes of all files that ``df`` is made from, listed one by one; none for rows without files."""
    jvm, conf, total = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def compact(df: DataFrame, path: str, target_files: int | None = None, sort_cols: Sequence[str] = (),
            fmt: str = "parquet", file_bytes: int = 512 << 20) -> DataFrame:
    """Rewrite a table into files of about ``file_bytes`` (or at most
    ``target_files`` files), sorted within files for better min/max skipping.
    Writes to ``path`` (a new location) and returns the rewritten table;
    ``publish.compact_published`` also switches a published table to it."""
    write_sized(df, path, sort_cols, file_bytes, target_files, fmt)
    return df.sparkSession.read.format(fmt).load(path)


def sized_files(df: DataFrame, sort_cols: Sequence[str] = (), file_bytes: int = 512 << 20,
                target_files: int | None = None) -> DataFrame:
    """``df`` in as many partitions as make files of about ``file_bytes``, sorted within."""
    if target_files is None:
        target_files = max(1, -(-stored_bytes(df) // file_bytes))
    if sort_cols:
        return df.repartitionByRange(target_files, *sort_cols).sortWithinPartitions(*sort_cols)
    return df.repartition(target_files)


RUN_BYTES = 32 << 20  # stored bytes that one task sorts; its rows take 10 to 20 times as much
FILES_AT_ONCE = 16


def sorted_runs(df: DataFrame, n: int, sort_cols: Sequence[str]) -> DataFrame:
    """``df`` in ``n`` ranges in order, each sorted; a value that fills several is split by its rows' hashes."""
    split = [F.xxhash64(c) for c, t in df.dtypes if "map<" not in t and t != "variant"]
    return df.repartitionByRange(n, *sort_cols, *split).sortWithinPartitions(*sort_cols)


def write_sized(df: DataFrame, path: str, sort_cols: Sequence[str] = (), file_bytes: int = 512 << 20,
                target_files: int | None = None, fmt: str = "parquet", run_bytes: int = RUN_BYTES) -> None:
    """Write ``sized_files(df)`` below ``path``.

    A file larger than ``run_bytes`` is not sorted by the task that writes it:
    small ranges are sorted and stored first, and the file's task reads its
    ranges in their order, so it holds no more than a page of them."""
    from strata.session import checkpoint_dir

    size = stored_bytes(df)
    files = target_files or max(1, -(-size // file_bytes))
    each = -(-size // (files * run_bytes))
    if not sort_cols or each <= 1:
        sized_files(df, sort_cols, target_files=files).write.mode("overwrite").format(fmt).save(path)
        return
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/sorted-runs-{uuid.uuid4().hex[:12]}"
    sorted_runs(df, files * each, sort_cols).write.parquet(at)
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    step, mode = FILES_AT_ONCE * each, "overwrite"
    for i in range(0, len(runs), step):
        some = runs[i:i + step]
        ordered = reduce(DataFrame.unionAll, [spark.read.schema(df.schema).parquet(r) for r in some])
        ordered.coalesce(-(-len(some) // each)).write.mode(mode).format(fmt).save(path)
        mode = "append"
    fs.delete(folder, True)


# ------------------------------------------------------------------ S12-S15
def capped_load(df: DataFrame, pk: Sequence[str], cap: int | None) -> DataFrame:
    """Key-deduped load, optionally capped at ``cap`` rows by key order.

    Dedupe keeps the smallest remaining tuple per key (deterministic).
    """
    from strata.operators.windows import latest_by

    rest = [c for c in df.columns if c not in pk]
    out = latest_by(df, pk, rest, ascending=True)
    if cap is not None:
        out = out.orderBy(*[F.col(k).asc_nulls_last() for k in pk]).limit(cap)
    return out


def cast_by_spec(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """SQL-type spec → tolerant casts (``DECIMAL(10,2)``, ``DATETIME2(3)``, ...)."""
    mapping = {}
    for c, t in spec.items():
        u = t.upper().replace(" ", "")
        if u.startswith(("NVARCHAR", "VARCHAR", "CHAR", "NCHAR", "TEXT")):
            mapping[c] = "string"
        elif u.startswith("DATETIME") or u.startswith("TIMESTAMP"):
            mapping[c] = "timestamp"
        elif u == "DATE":
            mapping[c] = "date"
        elif u.startswith("DECIMAL") or u.startswith("NUMERIC"):
            mapping[c] = t.lower().replace("numeric", "decimal")
        elif u in ("BIGINT",):
            mapping[c] = "bigint"
        elif u in ("INT", "INTEGER", "SMALLINT", "TINYINT"):
            mapping[c] = "int"
        elif u in ("FLOAT", "REAL", "DOUBLE"):
            mapping[c] = "double"
        elif u in ("BIT", "BOOLEAN", "BOOL"):
            mapping[c] = "boolean"
        else:
            mapping[c] = "string"
    return cast_cols(df, mapping)


def string_widths(df: DataFrame, cols: Sequence[str] | None = None, floor: int = 50,
                  cap: int = 4000) -> DataFrame:
    """Per string column ``max(length)`` and a declared width
    ``min(cap, greatest(2·max, floor))`` — one aggregate, stacked to rows."""
    cs = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    wide = df.agg(*[F.max(F.length(F.col(c))).alias(f"w{i}") for i, c in enumerate(cs)])
    parts = ", ".join(f"'{c}', w{i}" for i, c in enumerate(cs))
    return (wide.selectExpr(f"stack({len(cs)}, {parts}) as (column, max_length)")
            .withColumn("declared_width",
                        F.least(F.lit(cap), F.greatest(F.coalesce(F.col("max_length"), F.lit(0)) * 2,
                                                       F.lit(floor)))))


_INFER_ORDER = ("bool", "long", "real", "datetime")


def infer_types(df: DataFrame, cols: Sequence[str] | None = None, ts_col: str | None = None) -> DataFrame:
    """Infer a column type from string values (bool → long → real →
    datetime → string; blanks ignored; all-blank → string).

    One aggregate of ``bool_and(parses or blank)`` per type and column; the
    precedence is resolved in a ``CASE``.  ``ts_col`` is forced to datetime.
    """
    cs = cols or df.columns
    aggs = []
    for i, c in enumerate(cs):
        s = F.trim(F.col(c).cast("string"))
        blank = s.isNull() | (s == "")
        aggs.append(F.bool_or(~blank).alias(f"n{i}"))
        aggs.append(F.bool_and(blank | F.lower(s).isin("true", "false")).alias(f"b{i}"))
        aggs.append(F.bool_and(blank | s.try_cast("bigint").isNotNull()).alias(f"l{i}"))
        aggs.append(F.bool_and(blank | s.try_cast("double").isNotNull()).alias(f"r{i}"))
        aggs.append(F.bool_and(blank | F.try_to_timestamp(s).isNotNull()).alias(f"d{i}"))
    wide = df.agg(*aggs)
    exprs = []
    for i, c in enumerate(cs):
        if c == ts_col:
            exprs.append(f"'{c}', 'datetime'")
            continue
        exprs.append(
            f"'{c}', CASE WHEN NOT coalesce(n{i}, false) THEN 'string' WHEN b{i} THEN 'bool' "
            f"WHEN l{i} THEN 'long' WHEN r{i} THEN 'real' WHEN d{i} THEN 'datetime' ELSE 'string' END")
    return wide.selectExpr(f"stack({len(cs)}, {', '.join(exprs)}) as (column, inferred_type)")


# ------------------------------------------------------------------ S19/S20/S21
def audit_counts(spark: SparkSession, tables: Mapping[str, DataFrame | str]) -> DataFrame:
    """Row count per table as one job (``unionByName`` of count frames).

    A table that cannot be resolved is reported with a NULL count and the
    error message instead of failing the audit.
    """
    frames = []
    for name, src in tables.items():
        try:
            df = spark.table(src) if isinstance(src, str) else src
            frames.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                          .select(F.lit(name).alias("table_name"), "row_count",
                                  F.lit(None).cast("string").alias("error")))
        except Exception as e:  # noqa: BLE001 — the audit records, not raises
            frames.append(spark.range(1).select(F.lit(name).alias("table_name"),
                                                F.lit(None).cast("long").alias("row_count"),
                                                F.lit(str(e).splitlines()[0][:200]).alias("error")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pass_through(df: DataFrame, col_name: str = "silver_timestamp") -> DataFrame:
    """Dimension passed to the next layer with a layer timestamp."""
    return df.withColumn(col_name, F.current_timestamp())


def parse_events(df: DataFrame, json_col: str, fields: Sequence[str], prefix: str = "") -> DataFrame:
    """JSON payload → typed columns.

    Each field becomes ``bigint`` when every value in the batch is an
    integer, else ``double`` when numeric, else ``string``; blank → NULL.
    Per-row typing in the reference is replaced by column typing, which a
    table needs; the numeric value is kept exactly.
    """
    js = F.col(json_col)
    out = {}
    for f in fields:
        raw = F.nullif(F.trim(F.get_json_object(js, f"$.{f}")), F.lit(""))
        out[f"{prefix}{f}_long"] = raw.try_cast("bigint")
        out[f"{prefix}{f}_double"] = raw.try_cast("double")
        out[f"{prefix}{f}_text"] = raw
    return df.withColumns(out)


def parse_json(df: DataFrame, json_col: str, schema: StructType | str, alias: str = "payload") -> DataFrame:
    """``from_json`` with a declared schema (malformed → NULL fields)."""
    return df.withColumn(alias, F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"}))


def to_json_doc(df: DataFrame, name: str = "doc") -> DataFrame:
    """One-row metadata document as JSON text (the scoring metadata table)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_json_doc(df: DataFrame, col_name: str, schema: StructType | str) -> DataFrame:
    return df.select(F.from_json(F.col(col_name), schema).alias("d")).select("d.*")


def spec_json(path: str) -> dict:
    with open(path) as fh:
        return json.load(fh)
