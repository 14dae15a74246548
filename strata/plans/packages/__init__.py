"""Industry packages as declarative bronze → silver → gold compositions.

A ``Package`` names its landing tables (CSV, declared schema from FIXTURES),
the primary key used for the silver dedupe, a ``silver`` and a ``gold``
function built only from strata operators, reporting views (compositions of
operators over the silver and gold tables; a few that join or total whole
tables are SQL), and the stream configuration for the real-time queries.

``run_package`` wires the layers: bronze = CSV + provenance stamps, silver =
latest row per key by ingestion time then the package's typing, filters and
flags, gold = KPI tables, views = temp views over the gold tables.  Table
and view names carry the package prefix so packages can share a session.
With ``write_to`` set, every layer is written as parquet (the lineage is cut
at each layer, as the reference's table-per-layer design does).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import pct
from strata.operators.aggregates import kpi
from strata.operators.quality import project
from strata.operators.windows import latest_by
from strata.sources import bronze_stamp, create_view, read_csv

Tables = dict[str, DataFrame]


@dataclass
class Package:
    name: str
    sources: Mapping[str, str]                      # table → DDL schema (strings where the CSV is untyped)
    keys: Mapping[str, list[str]]                   # table → key for the silver dedupe
    silver: Callable[[Tables], Tables]
    gold: Callable[[Tables], Tables]
    # view → SQL with {p} table prefix, or a function of the silver and gold tables
    views: Mapping[str, str | Callable[[Tables], DataFrame]] = field(default_factory=dict)
    stream: Mapping[str, str] = field(default_factory=dict)  # table, signal, group, time
    date_cols: Mapping[str, Mapping[str, str | None]] = field(default_factory=dict)


PACKAGES = ["manufacturing", "retail", "energy", "financial", "healthcare", "hospitality", "construction",
            "education", "media", "technology", "professional", "transportation"]


def get(name: str) -> Package:
    return importlib.import_module(f"strata.plans.packages.{name}").PACKAGE


def dedupe_latest(bronze: Tables, keys: Mapping[str, list[str]]) -> Tables:
    """Silver step 1: latest row per key by ingestion time."""
    return {t: latest_by(df, keys[t], ["ingestion_timestamp"]) if t in keys else df for t, df in bronze.items()}


def run_package(spark: SparkSession, pkg: Package, landing: str, batch_id: str = "batch-1",
                write_to: str | None = None) -> dict[str, Tables]:
    p = f"{pkg.name}__"

    def written(layer: str, tables: Tables) -> Tables:
        """The layer as the next one reads it: its written copies, if it is written."""
        if not write_to:
            return tables
        out = {}
        for t, df in tables.items():
            df.write.mode("overwrite").parquet(f"{write_to}/{p}{layer}_{t}")
            out[t] = spark.read.parquet(f"{write_to}/{p}{layer}_{t}")
        return out

    bronze = {}
    for t, schema in pkg.sources.items():
        df = read_csv(spark, f"{landing}/{t}.csv", schema, date_cols=pkg.date_cols.get(t))
        bronze[t] = bronze_stamp(df, batch_id, batch_col="ingestion_batch_id")
    bronze = written("bronze", bronze)
    silver = written("silver", pkg.silver(dedupe_latest(bronze, pkg.keys)))
    gold = written("gold", pkg.gold(silver))
    layers = {"bronze": bronze, "silver": silver, "gold": gold}
    for t, df in gold.items():
        df.createOrReplaceTempView(f"{p}{t}")
    for t, df in silver.items():
        df.createOrReplaceTempView(f"{p}silver_{t}")
    layers["views"] = {}
    for v, made in pkg.views.items():
        if callable(made):
            made(silver | gold).createOrReplaceTempView(f"{p}{v}")
            layers["views"][v] = spark.table(f"{p}{v}")
        else:
            layers["views"][v] = create_view(spark, f"{p}{v}", made.format(p=p))
    return layers


def listing(table: str, names: str, where: Column | None = None, **made: Column) -> Callable[[Tables], DataFrame]:
    """A view that shows columns of a table (P1), of some rows (P8), with ``made`` ones replaced or added."""
    def view(t: Tables) -> DataFrame:
        df = t[table] if where is None else t[table].filter(where)
        return project(df.withColumns(made), names.split())

    return view


def grouped(table: str, keys: str, totals: str, **made: Column) -> Callable[[Tables], DataFrame]:
    """A view that rolls a table up (A11) by ``keys``; ``totals`` names the columns to sum (both as
    ``name`` or ``name=column``), ``made`` are further aggregates."""
    def named(names: str) -> dict[str, str]:
        return {n: c or n for n, _, c in (x.partition("=") for x in names.split())}

    def view(t: Tables) -> DataFrame:
        by = [F.col(c).alias(n) for n, c in named(keys).items()]
        return kpi(t[table], by, {n: F.sum(c) for n, c in named(totals).items()} | made)

    return view


def mean_of_means(c: str, weight: str, digits: int = 2) -> Column:
    """The mean over all rows behind a rollup, from each group's mean and row count."""
    return pct(F.sum(F.col(c) * F.col(weight)), F.sum(weight), digits, scale=1.0)


def stream_queries(pkg: Package, df: DataFrame, k: int = 20) -> Tables:
    """The package's real-time queries (T3–T8) from its stream configuration,
    on a batch or streaming ``df`` of the configured table."""
    from strata.streaming import group_signal, latest_n, sigma_outliers, store_count, tumbling_avg, tumbling_count

    c = pkg.stream
    ts, sig, grp = c["time"], c["signal"], c["group"]
    return {
        "records_per_minute": tumbling_count(df, ts, "1 minute"),
        "signal_avg_5min": tumbling_avg(df, ts, sig, "5 minutes", scale=None),
        "signal_by_group": group_signal(df, grp, sig, k, scale=None),
        "three_sigma_outliers": sigma_outliers(df, grp, sig, 3.0),
        "latest_100": latest_n(df, ts, 100),
        "row_count": store_count(df),
    }
