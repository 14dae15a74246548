"""Data contracts and ontology tables.

Checks are single-pass aggregates that return *counts*, never the offending
rows, so their cost is one scan regardless of how dirty the data is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.quality import try_cast_col


@dataclass
class ColumnRule:
    """One column's contract.  Every field is optional."""

    not_null: bool = False
    type: str | None = None             # text must parse as this type
    range: tuple[float | None, float | None] | None = None
    domain: Sequence | None = None


@dataclass
class Contract:
    columns: Mapping[str, ColumnRule] = field(default_factory=dict)


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """``(column, rule, violations)`` rows, computed in one aggregate.

    Missing columns are reported from the schema (no scan needed) with the
    table's row count as the violation count.
    """
    present = set(df.columns)
    aggs, labels = [], []
    for c, r in contract.columns.items():
        if c not in present:
            labels.append((c, "missing_column", None))
            continue
        x = F.col(c)
        if r.not_null:
            labels.append((c, "null", len(aggs)))
            aggs.append(F.count_if(x.isNull()))
        if r.type:
            labels.append((c, "unparsable", len(aggs)))
            aggs.append(F.count_if(x.isNotNull() & try_cast_col(x, r.type).isNull()))
        if r.range:
            lo, hi = r.range
            v = try_cast_col(x, "double") if r.type else x
            conds = []
            if lo is not None:
                conds.append(v < F.lit(lo))
            if hi is not None:
                conds.append(v > F.lit(hi))
            bad = conds[0] if len(conds) == 1 else conds[0] | conds[1]
            labels.append((c, "out_of_range", len(aggs)))
            aggs.append(F.count_if(F.coalesce(bad, F.lit(False))))
        if r.domain is not None:
            labels.append((c, "not_in_domain", len(aggs)))
            aggs.append(F.count_if(x.isNotNull() & ~x.isin(list(r.domain))))
    aggs.append(F.count(F.lit(1)))
    n_idx = len(aggs) - 1
    row = df.agg(*[a.cast("long").alias(f"a{i}") for i, a in enumerate(aggs)])
    stacked = ", ".join(
        f"'{c}', '{rule}', " + (f"a{i}" if i is not None else f"a{n_idx}")
        for c, rule, i in labels)
    if not labels:
        return row.selectExpr("cast(null as string) as column", "cast(null as string) as rule",
                              "cast(0 as bigint) as violations").limit(0)
    return row.selectExpr(f"stack({len(labels)}, {stacked}) as (column, rule, violations)")


def check_key(df: DataFrame, pk: Sequence[str], max_bytes: int | None = None) -> DataFrame:
    """C4: primary-key health in one row: rows, null keys, duplicate keys,
    widest key (bytes) and whether all checks pass.

    Duplicates are counted as ``rows - distinct keys`` among non-null keys —
    an aggregate, no self-join.
    """
    pk = list(pk)
    nullk = F.greatest(*[F.col(c).isNull().cast("int") for c in pk]) if len(pk) > 1 \
        else F.col(pk[0]).isNull().cast("int")
    width = sum_len = None
    for c in pk:
        ln = F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
        sum_len = ln if sum_len is None else sum_len + ln
    width = sum_len
    base = df.select(*pk, nullk.alias("__null"), width.alias("__w"))
    nn = base.filter(F.col("__null") == 0)
    distinct_keys = nn.select(*pk).distinct().select(F.count(F.lit(1))).scalar()
    out = base.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("__null").cast("long").alias("null_keys"),
        (F.sum(1 - F.col("__null")) - distinct_keys).cast("long").alias("duplicate_keys"),
        F.max("__w").cast("long").alias("max_key_bytes"),
    )
    ok = (F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0)
    if max_bytes is not None:
        ok = ok & (F.coalesce(F.col("max_key_bytes"), F.lit(0)) <= F.lit(max_bytes))
    return out.withColumn("key_ok", ok)


def duplicate_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """C4 detail: keys that occur more than once, with their counts."""
    return (df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def guard_label(df: DataFrame, label: str, min_rows: int = 100, min_pos_rate: float = 0.01,
                min_pos: int = 10, regression: bool = False) -> DataFrame:
    """M2: label/row-count guard statistics and verdict in one aggregate.

    Classification: rows ≥ min_rows and positives ≥ max(min_pos, rate·rows).
    Regression: rows ≥ min_rows and sample stddev > 0.
    """
    y = F.col(label).cast("double")
    st = df.agg(F.count(F.lit(1)).alias("rows"),
                F.sum(y).alias("positives"),
                F.stddev(y).alias("label_stddev"))
    if regression:
        ok = (F.col("rows") >= min_rows) & (F.coalesce(F.col("label_stddev"), F.lit(0.0)) > 0)
    else:
        need = F.greatest(F.lit(float(min_pos)), F.col("rows") * F.lit(min_pos_rate))
        ok = (F.col("rows") >= min_rows) & (F.coalesce(F.col("positives"), F.lit(0.0)) >= need)
    return st.withColumn("passed", ok)


# ------------------------------------------------------------------ ontology
def entities(df: DataFrame, id_col: str, display_col: str, props: Sequence[str]) -> DataFrame:
    """Entity table — identifier, display name, static properties; one row per id.

    Duplicate ids keep the greatest (display, props) tuple, deterministically.
    """
    packed = F.max(F.struct(F.col(display_col), *[F.col(p) for p in props]))
    return (df.filter(F.col(id_col).isNotNull())
            .groupBy(id_col).agg(packed.alias("__e"))
            .select(F.col(id_col).alias("entity_id"), F.col(f"__e.{display_col}").alias("display_name"),
                    *[F.col(f"__e.{p}").alias(p) for p in props]))


def entity_events(df: DataFrame, id_col: str, ts_cols: Sequence[str], props: Sequence[str],
                  cap: int | None = None) -> DataFrame:
    """Event table — identifier, ``timestamp_utc`` (first non-null of the
    candidate time columns) and time-series properties.

    ``cap`` reproduces the reference's packaging limit as an ordered limit
    (latest first); it is off by default so whole tables are kept.
    """
    ts = F.coalesce(*[F.col(c) for c in ts_cols])
    out = (df.select(F.col(id_col).alias("entity_id"), ts.alias("timestamp_utc"), *props)
           .filter(F.col("timestamp_utc").isNotNull()))
    if cap is not None:
        out = out.orderBy(F.col("timestamp_utc").desc(), F.col("entity_id")).limit(cap)
    return out
