"""Semantic measures.

A measure is a named aggregate evaluated under a grouping and filter
context.  ``measures(df, keys, {name: Measure})`` evaluates many of them in
one aggregate pass; composite measures (D6, D8, D9) are expressions over the
aggregated row.  Relationship navigation (D10) is an explicit left join to a
dimension whose key is checked unique first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """``agg`` is an aggregate Column; ``post`` (optional) derives a value from
    already-computed measure columns and is applied after the aggregate."""

    agg: Column | None = None
    post: Callable[[], Column] | None = None


def m_sum(c: str) -> Measure:
    return Measure(F.sum(c))


def m_avg(c: str) -> Measure:
    return Measure(F.avg(c))


def m_min(c: str) -> Measure:
    return Measure(F.min(c))


def m_max(c: str) -> Measure:
    return Measure(F.max(c))


def m_count() -> Measure:
    """D2 COUNTROWS."""
    return Measure(F.count(F.lit(1)))


def m_distinct(c: str) -> Measure:
    """D2 DISTINCTCOUNT."""
    return Measure(F.countDistinct(c))


def m_count_where(pred: Column) -> Measure:
    """D3 CALCULATE(COUNTROWS, pred) + 0: zero, never blank."""
    return Measure(F.count_if(F.coalesce(pred, F.lit(False))))


def m_distinct_where(c: str, values: Sequence) -> Measure:
    """D4 CALCULATE(DISTINCTCOUNT(c), c IN {...})."""
    return Measure(F.countDistinct(F.when(F.col(c).isin(list(values)), F.col(c))))


def m_sum_where(pred: Column, c: str) -> Measure:
    """D5 CALCULATE(SUM(c), pred)."""
    return Measure(F.sum(F.when(pred, F.col(c))))


def m_divide(num: str, den: str, scale: float = 1.0, alternate: float | None = None,
             digits: int | None = None) -> Measure:
    """D6 DIVIDE(num, den[, alternate]) * scale — on measure columns."""

    def post() -> Column:
        q = F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
        if alternate is not None:
            q = F.coalesce(q, F.lit(float(alternate)))
        q = q * F.lit(scale)
        return F.round(q, digits) if digits is not None else q

    return Measure(post=post)


def m_expr(fn: Callable[[], Column]) -> Measure:
    """Composite measure over other measures (IF/OR, arithmetic)."""
    return Measure(post=fn)


def measures(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Measure]) -> DataFrame:
    """Evaluate measures grouped by ``keys`` (empty → one grand-total row)."""
    aggs = [m.agg.alias(n) for n, m in spec.items() if m.agg is not None]
    base = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    for n, m in spec.items():
        if m.post is not None:
            base = base.withColumn(n, m.post())
    return base.select(*keys, *spec.keys())


def average_of_sums(df: DataFrame, keys: Sequence[str], per: str, c: str, name: str) -> DataFrame:
    """D7 AVERAGEX(VALUES(per), SUM(c)) — mean of per-key sums under ``keys``."""
    inner = df.groupBy(*keys, per).agg(F.sum(c).alias("__s"))
    out = inner.groupBy(*keys).agg(F.avg("__s").alias(name)) if keys else inner.agg(F.avg("__s").alias(name))
    return out


def navigate(fact: DataFrame, dim: DataFrame, fk: str, pk: str, cols: Sequence[str]) -> DataFrame:
    """Many-to-one navigation; the one side must have a unique key."""
    d = dim.select(F.col(pk).alias(fk) if pk != fk else F.col(pk), *cols)
    return fact.join(d, fk, "left")


def auto_measures(df: DataFrame, n_numeric: int = 3) -> DataFrame:
    """Row count + sum of the first ``n_numeric`` numeric columns; whole
    numbers as decimal(38,0), since sums of keys pass a long."""
    from pyspark.sql.types import IntegralType, NumericType

    nums = [f for f in df.schema.fields if isinstance(f.dataType, NumericType)][:n_numeric]
    total = lambda f: F.sum(F.col(f.name).cast("decimal(38,0)") if isinstance(f.dataType, IntegralType) else f.name)
    return df.agg(F.count(F.lit(1)).alias("row_count"), *[total(f).alias(f"total_{f.name}") for f in nums])
