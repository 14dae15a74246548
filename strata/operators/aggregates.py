"""Aggregation operators.

All grouped aggregates compile to partial + final hash aggregation, so a hot
key is combined map-side before the shuffle.  Global totals use a scalar
subquery (``DataFrame.scalar()``) instead of an unpartitioned window, so no
single task ever sees all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import col, pct, safe_div, week_start


# ------------------------------------------------------------------ helpers
def count_if(pred: Column) -> Column:
    """A5: conditional count (NULL predicate is not counted)."""
    return F.count_if(F.coalesce(pred, F.lit(False)))


def sum_if(pred: Column, c, otherwise=0) -> Column:
    """Conditional sum."""
    return F.sum(F.when(pred, col(c)).otherwise(F.lit(otherwise)))


def avg_if(pred: Column, c) -> Column:
    """Conditional average ignoring other rows."""
    return F.avg(F.when(pred, col(c)))


def rate(flag, digits: int = 2) -> Column:
    """Mean of a 0/1 flag × 100, rounded."""
    return F.round(F.avg(col(flag).cast("double")) * F.lit(100.0), digits)


def n_distinct(*cols) -> Column:
    """A3: exact distinct count."""
    return F.countDistinct(*[col(c) for c in cols])


# ------------------------------------------------------------------ A1, A12
def kpi(df: DataFrame, keys: Sequence[str | Column], aggs: Mapping[str, Column]) -> DataFrame:
    """A1: grouped KPI block — ``aggs`` is ``{output_name: aggregate}``."""
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])


def summary(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Global single-row summary."""
    return df.agg(*[e.alias(n) for n, e in aggs.items()])


def spread(df: DataFrame, keys: Sequence[str], cols: Sequence[str], digits: int = 4) -> DataFrame:
    """A4: per-group sample stddev, min, max and range (max − min)."""
    aggs = []
    for c in cols:
        aggs += [F.round(F.stddev(c), digits).alias(f"{c}_stddev"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                 F.round(F.max(c) - F.min(c), digits).alias(f"{c}_range")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def derive_kpis(df: DataFrame, specs: Mapping[str, tuple]) -> DataFrame:
    """A10: post-aggregate ratios ``{name: (num, den, scale, digits[, zero_value])}``."""
    new = {}
    for name, spec in specs.items():
        num, den, scale, digits = spec[:4]
        zero = spec[4] if len(spec) > 4 else None
        new[name] = pct(num, den, digits=digits, scale=scale, zero_value=zero)
    return df.withColumns(new)


def rollup_twice(df: DataFrame, inner_keys: Sequence[str], inner: Mapping[str, Column],
                 outer_keys: Sequence[str], outer: Mapping[str, Column]) -> DataFrame:
    """Aggregate to an inner grain, then re-aggregate to an outer grain."""
    mid = kpi(df, inner_keys, inner)
    return kpi(mid, outer_keys, outer)


# ------------------------------------------------------------------ A13, A14
def share_of_total(df: DataFrame, c: str, name: str = "share_pct", digits: int = 2,
                   materialize_input: bool = False) -> DataFrame:
    """Each row's share of the global total, in percent.

    The total is a scalar subquery evaluated once and inlined — no
    ``Window.partitionBy()`` (which would move every row to one task) and no
    driver round trip.  ``materialize_input`` writes ``df`` once first, for
    inputs that are expensive to compute (the subquery and the rows would
    otherwise each recompute them).
    """
    if materialize_input:
        from strata.session import materialize
        df = materialize(df, "share-input")
    total = df.select(F.sum(F.col(c).cast("double"))).scalar()
    return df.withColumn(name, F.round(F.try_divide(F.col(c).cast("double"), total) * F.lit(100.0), digits))


def share_of_group(df: DataFrame, keys: Sequence[str], c: str, name: str = "group_share_pct",
                   digits: int = 2, materialize_input: bool = False) -> DataFrame:
    """Each row's share of its group's total (aggregate + join back);
    ``materialize_input`` as in ``share_of_total``."""
    if materialize_input:
        from strata.session import materialize
        df = materialize(df, "share-input")
    tot = df.groupBy(*keys).agg(F.sum(F.col(c).cast("double")).alias("__grp_total"))
    return (df.join(tot, list(keys), "left")
            .withColumn(name, F.round(F.try_divide(F.col(c).cast("double"), F.col("__grp_total"))
                                      * F.lit(100.0), digits))
            .drop("__grp_total"))


# ------------------------------------------------------------------ A15
def dimension(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct projection (partial aggregation before the shuffle)."""
    return df.select(*cols).distinct()


# ------------------------------------------------------------------ A16-A19
def weekly(df: DataFrame, date_col: str, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Weekly trend keyed by ISO year and ISO week: a week at the turn of
    the year is one week, of the year its Thursday lies in."""
    d = F.to_date(F.col(date_col))
    return (df.withColumns({"year": F.date_part(F.lit("YEAROFWEEK"), d).cast("int"), "week": F.weekofyear(d)})
            .groupBy("year", "week", *keys)
            .agg(*[e.alias(n) for n, e in aggs.items()]))


def weekly_start(df: DataFrame, ts_col: str, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Weekly trend keyed by the Monday the week starts on."""
    return (df.withColumn("week_start", week_start(ts_col))
            .groupBy("week_start", *keys)
            .agg(*[e.alias(n) for n, e in aggs.items()]))


def series(df: DataFrame, ts_col: str, grain: str, keys: Sequence[str],
           aggs: Mapping[str, Column]) -> DataFrame:
    """Daily / hourly series per entity.  ``grain`` in {'day','hour'}."""
    if grain == "day":
        g = {"day": F.to_date(F.col(ts_col))}
    elif grain == "hour":
        g = {"day": F.to_date(F.col(ts_col)), "hour": F.hour(F.col(ts_col))}
    else:
        raise ValueError(grain)
    return df.withColumns(g).groupBy(*g.keys(), *keys).agg(*[e.alias(n) for n, e in aggs.items()])


# ------------------------------------------------------------------ A21-A24
def value_counts(df: DataFrame, c: str, name: str = "n") -> DataFrame:
    """Value frequencies, most frequent first (ties by value)."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(c))


def best_of(key: str, metric: str, worst: bool = False) -> Column:
    """A23 aggregate: the key with the highest (lowest) metric; ties → smallest key."""
    m = F.col(metric)
    order = F.struct(m, F.col(key)) if worst else F.struct(-m, F.col(key))
    return F.min_by(F.when(m.isNotNull(), F.col(key)), F.when(m.isNotNull(), order))


def arg_best(df: DataFrame, key: str, metric: str, worst: bool = False) -> DataFrame:
    """The entity with the highest (or lowest) metric, tie → smallest key.

    ``min_by`` over a struct tie-break — one partial aggregate, no sort.
    """
    val = F.min(metric) if worst else F.max(metric)
    return df.agg(best_of(key, metric, worst).alias(key), val.alias(metric))


def profile(df: DataFrame, cols: Sequence[str], digits: int = 4,
            scales: Mapping[str, int] | None = None) -> DataFrame:
    """Count / mean / stddev / min / max per column, as rows.

    One wide aggregate (single pass), then ``stack`` turns it into rows.
    Columns listed in ``scales`` (decimals carried by the data) get an exact,
    order-independent mean; other means are plain ``avg``.  Standard
    deviations are rounded to ``digits``.
    """
    from strata.functions import exact_avg

    scales = dict(scales or {})
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        mean = exact_avg(x, scales[c]) if c in scales else F.avg(x)
        aggs += [F.count(x).cast("double").alias(f"{c}__count"),
                 mean.alias(f"{c}__mean"),
                 F.round(F.stddev(x), digits).alias(f"{c}__stddev"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    parts = ", ".join(
        f"'{c}', `{c}__count`, `{c}__mean`, `{c}__stddev`, `{c}__min`, `{c}__max`" for c in cols)
    return wide.selectExpr(
        f"stack({len(cols)}, {parts}) as (column, count, mean, stddev, min, max)")


def kpi_cards(frames: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """One row of KPIs drawn from several tables.

    Each table is reduced to a one-row aggregate; the single rows are placed
    side by side through scalar subqueries (no cross join of data).
    """
    cols = []
    for df, exprs in frames:
        for name, e in exprs.items():
            cols.append(df.select(e).scalar().alias(name))
    spark = frames[0][0].sparkSession
    return spark.range(1).select(*cols)


def ratio(num: Column, den: Column) -> Column:
    return safe_div(num, den)


def worst_label(c, order: Sequence[str]) -> Column:
    """A20 (ordinal form): the worst label in a group, ``order`` listing worst
    first.  Unknown labels are ignored; the reference's ``max`` of the text is
    ``F.max(c)``."""
    arr = F.array(*[F.lit(x) for x in order])
    pos = F.nullif(F.array_position(arr, col(c)), F.lit(0))
    return F.element_at(arr, F.min(pos).cast("int"))


# ------------------------------------------------------------------ mergeable exact distinct counts
def distinct_bitmaps(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Keys, bucket, bits: the distinct values of a non-negative integer
    column as bitmaps of 32,768 values; partial sums in the scan's tasks, and
    several distinct counts need no Expand."""
    return df.where(F.col(c).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(c).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same bitmaps under coarser keys: days to weeks without a new scan."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """keys and the exact distinct count."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
