"""Sorts, limits and top-k.

Top-k uses ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps its own k best rows and only
k × #tasks rows reach the final merge — the limit is the feature here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.windows import ranked


def _order(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in cols]


def sort(df: DataFrame, cols: Sequence[str], descending: bool = False) -> DataFrame:
    """O1: ordered result (range-partitioned global sort)."""
    return df.orderBy(*_order(cols, descending))


def order_by_labels(df: DataFrame, c: str, labels: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """O2: custom category order; unknown labels last."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c))
    key = F.when(pos > 0, pos).otherwise(F.lit(len(labels) + 1))
    return df.orderBy(key, *[F.col(t) for t in then])


def top_k(df: DataFrame, c: str, k: int, ascending: bool = False,
          tiebreak: Sequence[str] = ()) -> DataFrame:
    """O3: top (or bottom) k rows with a deterministic tie-break."""
    first = F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_last() for t in tiebreak]).limit(k)


def limit_rows(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """Deterministic row sample — first k rows by key."""
    return df.orderBy(*[F.col(o).asc_nulls_last() for o in order]).limit(k)


def first_match(df: DataFrame, pred: Column, key: str) -> DataFrame:
    """First qualifying row by key."""
    return df.filter(pred).orderBy(F.col(key).asc_nulls_last()).limit(1)


def top_share(df: DataFrame, key: str, c: str, n: int, digits: int = 2) -> DataFrame:
    """Share of the total held by the top-n keys by ``c`` (dense rank ≤ n).

    Ranks are computed with the distributed ``ranked`` (no single-task window).
    Whole numbers are summed as decimals, exact beyond 2^53, and turned into
    doubles at the end; other columns are summed as doubles.
    """
    whole = dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint")
    per = df.groupBy(key).agg(F.sum(F.col(c).cast("decimal(38,0)" if whole else "double")).alias("__v"))
    r = ranked(per, ["__v"], (), True, "dense_rank", "__rk")
    return r.agg(
        F.sum(F.when(F.col("__rk") <= n, F.col("__v")).otherwise(F.lit(0))).cast("double").alias("top_value"),
        F.sum("__v").cast("double").alias("total_value"),
    ).withColumn("top_share_pct", F.round(F.try_divide(F.col("top_value"), F.col("total_value"))
                                          * F.lit(100.0), digits))
