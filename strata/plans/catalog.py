"""Registry of named queries over the shared driver tables.

Each entry pairs a Spark plan ``fn(spark, sf_dir) -> DataFrame`` with an
equivalent DuckDB SQL text (or ``None`` when the computation is not
SQL-expressible, e.g. model training) and the SURVEY ids it exercises.

Numeric conventions, so Spark and the SQL oracle agree bit for bit:
money and rates (two decimals) are summed in integer units and divided once
at the end (``exact_sum``); integer-valued doubles are averaged directly;
order-sensitive statistics (stddev) are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``ids`` lists SURVEY ids, space separated."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(ids.split()))
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ SQL snippets
def sql_units(x: str, scale: int = 2) -> str:
    return f"CAST(round({x} * {10 ** scale}.0) AS BIGINT)"


def sql_exact_sum(x: str, scale: int = 2) -> str:
    return f"(CAST(sum({sql_units(x, scale)}) AS DOUBLE) / CAST({10 ** scale} AS DOUBLE))"


def sql_exact_avg(x: str, scale: int = 2) -> str:
    return f"({sql_exact_sum(x, scale)} / count({x}))"


def sql_net_units(price: str, disc: str) -> str:
    return f"({sql_units(price)} * (100 - {sql_units(disc)}))"


# lineitem has repeated (orderkey, linenumber) pairs: keep the latest ship
# date, ties broken by the remaining columns in schema order (all descending).
SQL_LINEITEM_LATEST = """
SELECT * EXCLUDE (__rn) FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST,
             l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST,
             l_tax DESC NULLS LAST, l_returnflag DESC NULLS LAST, l_linestatus DESC NULLS LAST) AS __rn
  FROM lineitem) WHERE __rn = 1
"""
