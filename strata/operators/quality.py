"""Row validation, tolerant typing and null handling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, DoubleType, FloatType

from strata.functions import col


def project(df: DataFrame, cols: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Column subset; a mapping gives ``{source: alias}``."""
    if isinstance(cols, Mapping):
        return df.select(*[F.col(s).alias(a) for s, a in cols.items()])
    return df.select(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P2."""
    return df.withColumnsRenamed(dict(mapping))


def require_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows whose key columns are NULL."""
    return df.dropna(subset=list(cols))


def within(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """P5: inclusive physical range filter per column (NULL fails)."""
    cond = None
    for c, (lo, hi) in bounds.items():
        p = F.col(c).between(lo, hi)
        cond = p if cond is None else cond & p
    return df.filter(cond)


def positive(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Keep rows with every column > 0 (``strict``) or >= 0."""
    cond = None
    for c in cols:
        p = F.col(c) > 0 if strict else F.col(c) >= 0
        cond = p if cond is None else cond & p
    return df.filter(cond)


def keep_in(df: DataFrame, c: str, values: Iterable) -> DataFrame:
    """Membership filter (a literal IN list — pushed to the scan)."""
    return df.filter(F.col(c).isin(list(values)))


def alert_feed(df: DataFrame, predicate: Column, cols: Sequence[str | Column]) -> DataFrame:
    """Rows matching a (usually disjunctive) alert predicate, projected."""
    return df.filter(predicate).select(*cols)


_TS_TYPES = {"timestamp", "timestamp_ntz"}


def try_cast_col(c: Column | str, typ: str, fmt: str | None = None) -> Column:
    """Tolerant cast under ANSI mode: unparsable → NULL, blank → NULL."""
    x = col(c)
    t = typ.lower()
    if t in _TS_TYPES:
        s = F.nullif(F.trim(x.cast("string")), F.lit(""))
        return F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)
    if t == "date":
        s = F.nullif(F.trim(x.cast("string")), F.lit(""))
        ts = F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)
        return ts.cast("date")
    if t in ("boolean", "bool"):
        s = F.lower(F.trim(x.cast("string")))
        return (F.when(s.isin("true", "t", "yes", "y", "1"), F.lit(True))
                .when(s.isin("false", "f", "no", "n", "0"), F.lit(False)))
    return F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast(typ)


def cast_cols(df: DataFrame, mapping: Mapping[str, str | tuple[str, str]]) -> DataFrame:
    """Tolerant typing of text columns in one projection.

    ``mapping`` is ``{column: type}`` or ``{column: (type, format)}``.
    """
    new = {}
    for c, spec in mapping.items():
        typ, fmt = (spec, None) if isinstance(spec, str) else spec
        new[c] = try_cast_col(c, typ, fmt)
    return df.withColumns(new)


def fill_features(df: DataFrame, categorical: Sequence[str] = (), numeric: Sequence[str] | None = None,
                  cat_value: str = "unknown", num_value: float = 0) -> DataFrame:
    """NULL → ``'unknown'`` for categoricals and 0 for numerics."""
    out = df
    if categorical:
        out = out.na.fill(cat_value, subset=list(categorical))
    nums = list(numeric) if numeric is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if nums:
        out = out.na.fill(num_value, subset=nums)
    return out


def scrub_numeric(df: DataFrame, exclude: Sequence[str] = (), value: float = 0.0) -> DataFrame:
    """NULL/NaN → value on every numeric column found by dtype, in one select."""
    ex = set(exclude)
    cols = []
    for f in df.schema.fields:
        if f.name in ex or not isinstance(f.dataType, NumericType):
            cols.append(F.col(f.name))
            continue
        c = F.col(f.name)
        bad = c.isNull() | F.isnan(c) if isinstance(f.dataType, (DoubleType, FloatType)) else c.isNull()
        cols.append(F.when(bad, F.lit(value).cast(f.dataType)).otherwise(c).alias(f.name))
    return df.select(*cols)


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P3."""
    return df.drop(*cols)
