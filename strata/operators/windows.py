"""Window-style operators (W1–W10) written for skewed keys.

* ``latest_by`` (W1) keeps the latest row per key with ``max(struct(...))`` —
  a partial aggregate, so duplicates of a hot key are combined map-side
  instead of all rows of the key sorting in one task.
* ``rank_by`` / ``dense_rank_by`` / ``rank_in`` (W3–W5) never use an
  unpartitioned window.  Rows are reduced to distinct (group, value) counts,
  range-partitioned on (group, value) so one hot group is split over many
  tasks, ranked inside each range partition, and shifted by the running
  totals of the preceding partitions (a summary with at most
  #partitions + #groups rows).  Ties keep one rank, as SQL ``rank()``.
* Lags (W6/W7) run over per-entity series that are already aggregated to a
  period grain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import band


# ------------------------------------------------------------------ W1 / W2
def latest_by(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
              ascending: bool = False) -> DataFrame:
    """Keep one row per key: the greatest ``order_cols`` (or least if ``ascending``).

    Ties on ``order_cols`` are broken by the remaining columns in schema
    order, compared the same way, so the choice is deterministic.  Equivalent
    to ``row_number() over (partition by keys order by order_cols desc, rest
    desc) = 1`` with NULLs last.
    """
    keys = list(keys)
    order = list(order_cols)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest])
    pick = F.min(packed) if ascending else F.max(packed)
    return (df.groupBy(*keys).agg(pick.alias("__row"))
            .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in order + rest])
            .select(*df.columns))


def drop_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep any one row per key (hash aggregate with map-side combine)."""
    return df.dropDuplicates(list(keys))


# ------------------------------------------------------------------ ranks
def _sort_expr(c: str, descending: bool, nulls_last: bool | None) -> Column:
    x = F.col(c)
    if descending:
        return x.desc_nulls_first() if nulls_last is False else x.desc_nulls_last()
    return x.asc_nulls_last() if nulls_last else x.asc_nulls_first()


def _null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    cond = None
    for c in cols:
        p = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = p if cond is None else cond & p
    return left.join(r, cond, "inner").drop(*[f"__r_{c}" for c in cols])


def ranked(df: DataFrame, order: Sequence[str], partition_by: Sequence[str] = (),
           descending: bool | Sequence[bool] = True, method: str = "rank",
           name: str = "rank", nulls_last: bool | None = None,
           num_partitions: int | None = None, materialize_input: bool = True) -> DataFrame:
    """Distributed ``rank`` / ``dense_rank`` over an optional partition.

    Same result as ``rank() over (partition by P order by O)`` without
    collecting a partition (or the whole table) into one task.

    The distinct values with their counts and range numbers are written once:
    ranks do not depend on a plan's exchanges being reused.  The input itself
    is read twice (value counts, then the join back), so it is
    written once to the checkpoint folder and not recomputed; pass
    ``materialize_input=False`` when the input is a plain scan, which is
    cheaper to read twice than to copy.
    """
    from strata.session import materialize

    if materialize_input:
        df = materialize(df, "rank-input")
    part = list(partition_by)
    vals = list(order)
    desc = [descending] * len(vals) if isinstance(descending, bool) else list(descending)
    sorts = [F.col(k).asc_nulls_first() for k in part] + [
        _sort_expr(v, d, nulls_last) for v, d in zip(vals, desc)]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    counts = df.groupBy(*part, *vals).agg(F.count(F.lit(1)).alias("__n"))
    # range bounds are sampled anew for each exchange, so the numbering is
    # written once and both branches below read the same one
    rp = materialize(counts.repartitionByRange(n, *sorts).withColumn("__pid", F.spark_partition_id()), "rank-ranges")
    w_local = Window.partitionBy("__pid", *part).orderBy(*sorts)
    local = (rp.withColumn("__before", F.coalesce(
                 F.sum("__n").over(w_local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("__idx", F.row_number().over(w_local)))
    summ = local.groupBy("__pid", *part).agg(F.sum("__n").alias("__pn"),
                                              F.count(F.lit(1)).alias("__pd"))
    w_off = Window.partitionBy(*part).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = (summ.withColumn("__off_n", F.coalesce(F.sum("__pn").over(w_off), F.lit(0)))
                .withColumn("__off_d", F.coalesce(F.sum("__pd").over(w_off), F.lit(0)))
                .select("__pid", *part, "__off_n", "__off_d"))
    # group keys may be NULL: join null-safely on (pid, group)
    key_cols = ["__pid", *part]
    ranks = _null_safe_join(local, offs, key_cols)
    if method == "rank":
        r = F.col("__off_n") + F.col("__before") + F.lit(1)
    elif method == "dense_rank":
        r = F.col("__off_d") + F.col("__idx")
    else:
        raise ValueError(method)
    ranks = ranks.select(*part, *vals, r.cast("long").alias(name))
    return _null_safe_join(df, ranks, part + vals)


def dense_rank_by(df: DataFrame, c: str, descending: bool = True, name: str = "rank",
                  materialize_input: bool = True) -> DataFrame:
    """Dense rank over the whole table."""
    return ranked(df, [c], (), descending, "dense_rank", name, materialize_input=materialize_input)


def rank_by(df: DataFrame, c: str, descending: bool = True, name: str = "rank",
            materialize_input: bool = True) -> DataFrame:
    """Rank over the whole table, NULLs last."""
    return ranked(df, [c], (), descending, "rank", name, nulls_last=True, materialize_input=materialize_input)


def rank_in(df: DataFrame, part: Sequence[str], c: str, descending: bool = True,
            name: str = "rank", method: str = "rank", materialize_input: bool = True) -> DataFrame:
    """Rank within a partition."""
    return ranked(df, [c], part, descending, method, name, materialize_input=materialize_input)


# ------------------------------------------------------------------ W6 / W7
def lag_features(df: DataFrame, keys: Sequence[str], order: str,
                 lags: Mapping[str, Sequence[int]]) -> DataFrame:
    """``{col: [n, ...]}`` → ``{col}_lag_{n}`` per entity series."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = {f"{c}_lag_{n}": F.lag(c, n).over(w) for c, ns in lags.items() for n in ns}
    return df.withColumns(new)


def trend(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, c: str,
          up: float, down: float, digits: int | None = 2, pct_digits: int = 1,
          labels: tuple[str, str, str] = ("Improving", "Declining", "Stable"),
          first_label: str | None = None) -> DataFrame:
    """Previous period, change, percent change and a direction label.

    The first period has no previous value: its change is NULL and its label
    is ``first_label`` (NULL by default; the reference labels it 'Stable').
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.lag(c, 1).over(w)
    out = df.withColumn(f"prev_{c}", prev)
    chg = F.col(c) - F.col(f"prev_{c}")
    if digits is not None:
        chg = F.round(chg, digits)
    pctc = F.when(F.col(f"prev_{c}") > 0,
                  F.round((F.col(c) - F.col(f"prev_{c}")) / F.col(f"prev_{c}") * F.lit(100.0), pct_digits))
    out = out.withColumns({f"{c}_change": chg, f"{c}_change_pct": pctc})
    lab = band(F.col(f"{c}_change"), [(">", up, labels[0]), ("<", down, labels[1])], labels[2])
    lab = F.when(F.col(f"{c}_change").isNull(), F.lit(first_label)).otherwise(lab)
    return out.withColumn(f"{c}_trend", lab)


# ------------------------------------------------------------------ W8 / W9
def sigma_flag(df: DataFrame, keys: Sequence[str], c: str, k: float = 2.0,
               name: str | None = None, keep_stats: bool = False) -> DataFrame:
    """Flag rows farther than ``k`` sample stddevs from their group mean.

    A group with one reading has NULL stddev → flag False (not NULL).
    Aggregate + join (partial aggregation) rather than a partition window; the
    aggregate is written first, so that AQE can split a hot key at the join.
    """
    from strata.session import materialize

    name = name or f"{c}_anomaly"
    st = materialize(df.groupBy(*keys).agg(F.avg(c).alias(f"__avg_{c}"), F.stddev(c).alias(f"__std_{c}")), "sigma-stats")
    out = df.join(st, list(keys), "left")
    cond = F.abs(F.col(c) - F.col(f"__avg_{c}")) > F.lit(k) * F.col(f"__std_{c}")
    out = out.withColumn(name, F.coalesce(cond, F.lit(False)))
    if keep_stats:
        return out.withColumnsRenamed({f"__avg_{c}": f"avg_{c}", f"__std_{c}": f"std_{c}"})
    return out.drop(f"__avg_{c}", f"__std_{c}")


def repeat_flag(df: DataFrame, key: str, name: str = "is_repeat", as_int: bool = True) -> DataFrame:
    """1 when the key occurs more than once (count per key joined back)."""
    from strata.session import materialize

    cnt = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("__cnt")), "key-counts")
    f = F.col("__cnt") > 1
    return (df.join(cnt, key, "left")
            .withColumn(name, f.cast("int") if as_int else f).drop("__cnt"))


def lag_ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: dict[str, tuple[str, int]],
               num_partitions: int | None = None) -> DataFrame:
    """``lag(c, n) over (partition by keys order by order)`` for lags
    {name: (c, n)}, where one key may hold any share of the rows.

    Rows are dealt by range of (keys, order), so a hot key spans many tasks; a
    range also gets, for each of its keys, the last rows that earlier ranges
    hold of it (at most the greatest n).  ``order`` makes rows of a key
    distinct.  The dealt rows are written once, since range bounds are sampled."""
    from strata.session import materialize

    keys, order = list(keys), list(order)
    most = max(n for _, n in lags.values())
    cols = list(dict.fromkeys([*keys, *order, *[c for c, _ in lags.values()]]))
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("__pid", F.spark_partition_id()), "lag-ranges")
    # last rows of each key in each range; few keys lie in more than one
    back = Window.partitionBy("__pid", *keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = (dealt.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= most)
             .groupBy("__pid", *keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("at"), F.struct(*cols).alias("row"))))
                                          .alias("__tail")))
    # every range before holds a row at least, so as many ranges as rows are enough
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(-most, -1)
    halo = (tails.withColumn("__rows", F.flatten(F.collect_list("__tail").over(before))).where(F.size("__rows") > 0)
            .select("__pid", F.explode(F.slice("__rows", F.greatest(F.size("__rows") - most + 1, F.lit(1)), most)).alias("x"))
            .select("__pid", "x.row.*").withColumn("__halo", F.lit(True)))
    both = dealt.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy("__pid", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = both.select("*", *[F.lag(c, n).over(w).alias(name) for name, (c, n) in lags.items()])
    return out.where(~F.col("__halo")).select(*df.columns, *lags)
