"""Join operators.

Broadcast policy: a dimension is broadcast explicitly only when its size is
bounded by definition (``fixed_size=True``, e.g. nation/region); otherwise
AQE converts a join to a broadcast hash join when the *measured* shuffle size
is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and falls back to
a sort-merge join with skew splitting beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key_list(on) -> list:
    return [on] if isinstance(on, (str, tuple)) else list(on)


def enrich(fact: DataFrame, dim: DataFrame, on, cols: Sequence[str] | None = None,
           how: str = "left", fixed_size: bool = False) -> DataFrame:
    """Left equi-join of a fact to a dimension.

    ``on`` is a column name, a list of names (composite key), or a
    ``(fact_col, dim_col)`` tuple / list of tuples when names differ.  Only
    ``cols`` (plus the key) are taken from the dimension; any other column
    that would clash is dropped from the dimension side first, so no
    ambiguous names survive.
    """
    keys = _key_list(on)
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    dim_keys = [d for _, d in pairs]
    take = list(cols) if cols is not None else [c for c in dim.columns if c not in dim_keys]
    clash = [c for c in take if c in fact.columns and c not in dim_keys]
    take = [c for c in take if c not in clash]
    right = dim.select(*dict.fromkeys(dim_keys + take))
    if fixed_size:
        right = F.broadcast(right)
    if all(f == d for f, d in pairs):
        return fact.join(right, [f for f, _ in pairs], how)
    # differing names: rename the dimension keys to the fact names, then join
    # on names so the key appears once (the reference drops the right key).
    ren = {d: f"__k{i}" for i, (_, d) in enumerate(pairs)}
    r = right.withColumnsRenamed(ren)
    cond = None
    for i, (f, _) in enumerate(pairs):
        p = fact[f] == r[f"__k{i}"]
        cond = p if cond is None else cond & p
    out = fact.join(r, cond, how)
    return out.drop(*ren.values())


def enrich_as(fact: DataFrame, dim: DataFrame, fk: str, dim_key: str, prefix: str,
              cols: Sequence[str]) -> DataFrame:
    """Role-playing dimension — the same dimension joined under a prefix."""
    r = dim.select(F.col(dim_key).alias(f"__{prefix}key"),
                   *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return fact.join(r, fact[fk] == r[f"__{prefix}key"], "left").drop(f"__{prefix}key")


def star(fact: DataFrame, dims: Sequence[tuple]) -> DataFrame:
    """Chain of left joins.  Each item is ``(dim, on, cols[, fixed_size])``."""
    out = fact
    for item in dims:
        dim, on, cols = item[0], item[1], item[2]
        fixed = item[3] if len(item) > 3 else False
        out = enrich(out, dim, on, cols, fixed_size=fixed)
    return out


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Group statistics joined back onto every row.

    Aggregate-then-join instead of a partition window: the aggregate is
    partially computed map-side, so a key holding a third of the rows never
    lands whole in one task.  It is written before the join back: AQE splits a
    hot key only where both inputs of the join are plain shuffles.
    """
    from strata.session import materialize

    agg = materialize(df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()]), "group-stats")
    return df.join(agg, list(keys), "left")


def scorecard(dim: DataFrame, key: str | Sequence[str],
              facts: Sequence[tuple[DataFrame, str | Sequence[str], Mapping[str, Column]]],
              fill: Mapping[str, object] | None = None) -> DataFrame:
    """Aggregate each fact to the dimension grain first, then left-join.

    No fan-out: every fact is reduced to one row per key before it meets the
    dimension, so the dimension row count is preserved.
    """
    dkeys = [key] if isinstance(key, str) else list(key)
    out = dim
    for fact, fkey, aggs in facts:
        fkeys = [fkey] if isinstance(fkey, str) else list(fkey)
        a = fact.groupBy(*fkeys).agg(*[e.alias(n) for n, e in aggs.items()])
        if fkeys != dkeys:
            a = a.withColumnsRenamed(dict(zip(fkeys, dkeys)))
        out = out.join(a, dkeys, "left")
    if fill:
        out = out.na.fill(dict(fill))
    return out


def label_from_events(base: DataFrame, events: DataFrame, keys: Sequence[str],
                      name: str) -> DataFrame:
    """Left join to (distinct) event keys → 1 if any event else 0."""
    ev = events.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return (base.join(ev, list(keys), "left")
            .withColumn(name, F.coalesce(F.col("__hit"), F.lit(0)))
            .drop("__hit"))


def edges(df: DataFrame, src_key: str, fk: str, relationship: str) -> DataFrame:
    """Relationship rows ``(src, dst, relationship)`` from a foreign key."""
    return (df.select(F.col(src_key).alias("src"), F.col(fk).alias("dst"))
            .filter(F.col("dst").isNotNull())
            .distinct()
            .withColumn("relationship", F.lit(relationship)))


def orphans(edge_df: DataFrame, targets: DataFrame, target_key: str) -> DataFrame:
    """Edges whose destination has no entity row (left anti join)."""
    t = targets.select(F.col(target_key).alias("dst"))
    return edge_df.join(t, "dst", "left_anti")
