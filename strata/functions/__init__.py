"""Column builders (scalar expressions).

Everything here returns a ``pyspark.sql.Column`` built from JVM-side
built-ins, so it folds into whole-stage codegen.  No Python UDFs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cmp(c: Column, op: str, limit) -> Column:
    lim = F.lit(limit) if not isinstance(limit, Column) else limit
    if op == ">=":
        return c >= lim
    if op == ">":
        return c > lim
    if op == "<=":
        return c <= lim
    if op == "<":
        return c < lim
    if op == "==":
        return c == lim
    if op == "!=":
        return c != lim
    raise ValueError(f"unknown comparison {op!r}")


# ---------------------------------------------------------------- P10 banding
def band(c: ColumnOrName, rules: Sequence[tuple[str, object, str]], default=None,
         null_label: str | None = None) -> Column:
    """Ordered threshold banding: first matching ``(op, limit, label)`` wins.

    ``null_label`` (when given) is returned for a NULL input instead of falling
    through to ``default`` — the reference lets NULL fall into the last band,
    which we keep available by leaving ``null_label`` unset.
    """
    x = col(c)
    expr = None
    if null_label is not None:
        expr = F.when(x.isNull(), F.lit(null_label))
    for op, limit, label in rules:
        cond = _cmp(x, op, limit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


# ---------------------------------------------------------------- P11 day part
def day_part(ts: ColumnOrName, cuts: Sequence[tuple[int, str]], last: str) -> Column:
    """Hour-of-day bucket: ``cuts`` is ``[(upper_hour_exclusive, label), ...]``.

    Fixed values used by the packages: ``[(8,'Night'),(16,'Day')], 'Evening'``
    and ``[(12,'Morning'),(17,'Afternoon')], 'Evening'``.
    """
    h = F.hour(col(ts))
    return band(h, [("<", hi, label) for hi, label in cuts], last)


# ---------------------------------------------------------------- P12 category
def map_category(c: ColumnOrName, groups: Mapping[str, Iterable], default=None) -> Column:
    """Map values to labels by membership lists (first list that matches)."""
    x = col(c)
    expr = None
    for label, values in groups.items():
        cond = x.isin(list(values))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


# ---------------------------------------------------------------- P13 / P15
def flag(pred: Column, as_int: bool = True, null_as_false: bool = True) -> Column:
    """Boolean or 0/1 flag from a predicate (NULL predicate → false by default)."""
    p = F.coalesce(pred, F.lit(False)) if null_as_false else pred
    return p.cast("int") if as_int else p


def any_flag(preds: Sequence[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def all_flag(preds: Sequence[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


# ---------------------------------------------------------------- P14
def rule_flag(type_col: ColumnOrName, value_col: ColumnOrName,
              rules: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Type-dependent out-of-range flag: ``{type: (low, high)}``; value outside → True.

    Types without a rule give False.  The rule table is tiny and fixed, so it
    is inlined as a CASE chain rather than joined.
    """
    t, v = col(type_col), col(value_col)
    expr = None
    for typ, (lo, hi) in rules.items():
        parts = []
        if lo is not None:
            parts.append(v < F.lit(lo))
        if hi is not None:
            parts.append(v > F.lit(hi))
        cond = any_flag(parts) if parts else F.lit(False)
        expr = (F.when(t == F.lit(typ), cond) if expr is None
                else expr.when(t == F.lit(typ), cond))
    return F.coalesce(expr.otherwise(F.lit(False)), F.lit(False)) if expr is not None else F.lit(False)


# ---------------------------------------------------------------- P16 / P17
def weighted_score(weights: Mapping[str, float] | Sequence[tuple[Column, float]]) -> Column:
    """Additive score: sum of ``flag.cast(int) * weight`` (NULL flag counts 0)."""
    items = weights.items() if isinstance(weights, Mapping) else weights
    total = None
    for f, w in items:
        term = F.coalesce(col(f).cast("int"), F.lit(0)) * F.lit(w)
        total = term if total is None else total + term
    return total


def health_score(base: float, terms: Sequence[tuple[ColumnOrName, float]], floor: float = 0.0,
                 digits: int = 1) -> Column:
    """Clamped linear score ``max(floor, base - Σ w·x)`` rounded.

    A NULL term (e.g. stddev of a single reading) makes the score NULL only if
    the reference would; we treat a NULL term as 0 so one-reading groups score.
    """
    s = F.lit(float(base))
    for c, w in terms:
        s = s - F.coalesce(col(c), F.lit(0.0)) * F.lit(w)
    return F.round(F.greatest(F.lit(float(floor)), s), digits)


# ---------------------------------------------------------------- P18
def worst_of(labels: Sequence[ColumnOrName], order: Sequence[str], default=None) -> Column:
    """Ordinal worst-of several band labels (``order`` lists worst first)."""
    cols = [col(c) for c in labels]
    expr = None
    for lab in order:
        cond = any_flag([c == F.lit(lab) for c in cols])
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(default))


def matrix_band(cells: Sequence[tuple[Column, str]], default=None) -> Column:
    """Multi-column performance matrix: first predicate over several columns wins."""
    expr = None
    for pred, label in cells:
        expr = F.when(pred, F.lit(label)) if expr is None else expr.when(pred, F.lit(label))
    return expr.otherwise(F.lit(default))


# ---------------------------------------------------------------- P19 - P25
def pct(num: ColumnOrName, den: ColumnOrName, digits: int | None = 2, scale: float = 100.0,
        zero_value=None) -> Column:
    """``round(num / den * scale, digits)``; zero or NULL denominator → ``zero_value``.

    ``digits=None`` keeps full precision (useful when exact ties matter).
    """
    q = F.try_divide(col(num).cast("double"), col(den).cast("double")) * F.lit(scale)
    r = F.round(q, digits) if digits is not None else q
    return r if zero_value is None else F.coalesce(r, F.lit(zero_value))


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def net_amount(qty: ColumnOrName, price: ColumnOrName, disc: ColumnOrName,
               disc_is_pct: bool = False, digits: int | None = 2) -> Column:
    """Line total ``qty × price × (1 − discount)``; ``disc_is_pct`` for 0–100 inputs."""
    d = col(disc) / F.lit(100.0) if disc_is_pct else col(disc)
    v = col(qty) * col(price) * (F.lit(1.0) - d)
    return F.round(v, digits) if digits is not None else v


def deviation(c: ColumnOrName, nominal: float) -> Column:
    return F.abs(col(c) - F.lit(nominal))


def row_mean(cols: Sequence[ColumnOrName], digits: int = 2, skip_nulls: bool = False) -> Column:
    """Mean of several columns.  ``skip_nulls`` averages only the present ones."""
    cs = [col(c) for c in cols]
    if not skip_nulls:
        s = cs[0]
        for c in cs[1:]:
            s = s + c
        return F.round(s / F.lit(float(len(cs))), digits)
    total = None
    n = None
    for c in cs:
        v = F.coalesce(c, F.lit(0.0))
        k = c.isNotNull().cast("int")
        total = v if total is None else total + v
        n = k if n is None else n + k
    return F.round(F.try_divide(total, n.cast("double")), digits)


def oee(availability: Column, performance: Column, quality: Column, digits: int = 2) -> Column:
    return F.round(availability * performance * quality * F.lit(100.0), digits)


def oee_parts(downtime: ColumnOrName, batches: ColumnOrName, produced: ColumnOrName,
              planned: ColumnOrName, defects: ColumnOrName, shift_minutes: int = 480,
              digits: int = 4) -> dict[str, Column]:
    """Availability / performance / quality with zero guards."""
    avail = F.round(F.lit(1.0) - safe_div(downtime, col(batches) * F.lit(shift_minutes)), digits)
    perf = F.round(safe_div(produced, planned), digits)
    qual = F.round(safe_div(col(produced) - col(defects), produced), digits)
    return {"availability": avail, "performance": perf, "quality": qual}


def tenure(start: ColumnOrName, end: ColumnOrName | None = None, as_of: str | None = None,
           unit: str = "days", digits: int = 1) -> Column:
    """Days (or years) between start and end; open end → ``as_of`` date.

    ``as_of`` is a parameter (ISO date) so results are reproducible; when it
    is None the current date is used, as the reference does.
    """
    ref = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    e = F.coalesce(F.to_date(col(end)), ref) if end is not None else ref
    d = F.datediff(e, F.to_date(col(start)))
    if unit == "days":
        return d
    if unit == "years":
        return F.round(d / F.lit(365.25), digits)
    if unit == "months":
        return F.round(d / F.lit(30.44), digits)
    raise ValueError(unit)


def amount_if(pred: Column, c: ColumnOrName, otherwise=0.0) -> Column:
    return F.when(pred, col(c)).otherwise(F.lit(otherwise))


def prefix_group(c: ColumnOrName, n: int) -> Column:
    return F.substring(col(c), 1, n)


# ---------------------------------------------------------------- exact money
def units(c: ColumnOrName, scale: int = 2) -> Column:
    """Fixed-point integer units (``scale`` decimals) of a decimal-valued double.

    Money and rates in the tables carry at most two decimals; summing their
    integer units is exact and independent of summation order, so a total over
    billions of rows does not drift and every engine returns the same value.
    """
    return F.round(col(c) * F.lit(float(10 ** scale))).cast("long")


def exact_sum(c: ColumnOrName, scale: int = 2) -> Column:
    """Order-independent sum of a ``scale``-decimal column, as double."""
    return F.sum(units(c, scale)) / F.lit(float(10 ** scale))


def wide_sum(units_: Column, scale: int = 4) -> Column:
    """Sum of integer units over whole tables, as double: ``decimal(38,0)``
    holds totals that a long overflows at (some 1e10 lines)."""
    return F.sum(units_.cast("decimal(20,0)")).cast("double") / F.lit(float(10 ** scale))


def exact_avg(c: ColumnOrName, scale: int = 2) -> Column:
    """Order-independent mean of a ``scale``-decimal column, as double."""
    return F.sum(units(c, scale)) / F.lit(float(10 ** scale)) / F.count(col(c))


def net_units(price: ColumnOrName, disc: ColumnOrName) -> Column:
    """Net line amount ``price × (1 − discount)`` in 1/10000 units (exact)."""
    return units(price, 2) * (F.lit(100) - units(disc, 2))


# ---------------------------------------------------------------- calendar
def year_week(d: ColumnOrName, iso_year: bool = False) -> Column:
    """``YYYY-Www`` label.  Default keeps the calendar year with the ISO week
    (the reference's label: 2024-12-30 → 2024-W01); ``iso_year`` uses the ISO
    week-based year instead."""
    dt = F.to_date(col(d))
    wk = F.weekofyear(dt)
    if iso_year:
        # ISO year = year of the Thursday in the same ISO week.
        yr = F.year(F.date_add(dt, F.lit(3) - ((F.dayofweek(dt) + F.lit(5)) % F.lit(7))))
    else:
        yr = F.year(dt)
    return F.concat_ws("-W", yr.cast("string"), F.lpad(wk.cast("string"), 2, "0"))


def weekday_monday0(d: ColumnOrName) -> Column:
    """Monday=0 … Sunday=6 from Spark's Sunday=1 ``dayofweek``."""
    return (F.dayofweek(col(d)) + F.lit(5)) % F.lit(7)


def is_weekend(d: ColumnOrName) -> Column:
    return F.dayofweek(col(d)).isin(1, 7)


def in_hours(ts: ColumnOrName, ranges: Sequence[tuple[int, int]]) -> Column:
    """Rush-hour style flag: hour within any inclusive ``(lo, hi)`` range."""
    h = F.hour(col(ts))
    return any_flag([h.between(lo, hi) for lo, hi in ranges])


def week_start(ts: ColumnOrName) -> Column:
    """Monday of the week as a date (``date_trunc('week')``)."""
    return F.to_date(F.date_trunc("week", col(ts)))


# ---------------------------------------------------------------- U1
def positive_probability(prob_col: ColumnOrName) -> Column:
    """Positive-class probability out of an ML probability vector.

    NULL or one-element vectors give 0.0.  Uses ``vector_to_array`` (JVM)
    rather than a Python UDF.
    """
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(col(prob_col))
    return F.coalesce(F.when(F.size(arr) > 1, F.element_at(arr, 2)), F.lit(0.0))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations",)]
