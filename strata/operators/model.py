"""Relationship model (D10): declared relations, joins and filters derived from them.

A relation goes from a foreign key (many side) to a key (one side).  Columns of
the one side are reached from the many side by joins along declared relations.  A filter
on a table holds for every table that its relations lead to: always from the one
side to the many side, and back only where the relation is declared ``both``
ways.  A filter travels as left-semi joins on key columns alone, so it neither
multiplies nor carries rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KEY_BYTES, ROW_BYTES = 4 << 20, 32 << 20  # stored bytes of the one side and of the many side for a task


@dataclass(frozen=True)
class Relation:
    many: str
    many_key: str
    one: str
    one_key: str
    both: bool = False


class Model:
    def __init__(self, tables: Mapping[str, DataFrame], relations: Sequence[Relation]):
        self.tables, self.relations = dict(tables), list(relations)
        for r in relations:
            for t, c in ((r.many, r.many_key), (r.one, r.one_key)):
                if t not in self.tables or c not in self.tables[t].columns:
                    raise ValueError(f"{t}.{c} is not in the model")

    def check(self) -> DataFrame:
        """relation, repeated_keys and null_keys of the one side, and orphans
        (many-side keys without a row there); a sound relation has none of the first two."""
        from strata.sources import input_bytes

        out = None
        for r in self.relations:
            # one sum by key instead of an anti join, below which all rows of the many side would be sorted; in as many
            # tasks as the keys need, because small shuffled keys would be put together to a few tasks of many rows
            k = self.tables[r.one].select(F.col(r.one_key).alias("k"), F.lit(1).cast("long").alias("n")).unionAll(
                self.tables[r.many].select(F.col(r.many_key).alias("k"), F.lit(0).cast("long").alias("n")).where("k IS NOT NULL"))
            size = input_bytes(self.tables[r.one])
            tasks = -(-size // KEY_BYTES) + input_bytes(self.tables[r.many]) // ROW_BYTES
            keys = (k.repartition(tasks, "k") if size > KEY_BYTES else k).groupBy("k").agg(F.sum("n").alias("n"))
            null = F.col("k").isNull()
            part = keys.select((~null & (F.col("n") > 1)).cast("long").alias("repeated_keys"),
                               F.when(null, F.col("n")).otherwise(0).alias("null_keys"),
                               (~null & (F.col("n") == 0)).cast("long").alias("orphans"),
                               F.lit(f"{r.many}.{r.many_key} -> {r.one}.{r.one_key}").alias("relation"))
            out = part if out is None else out.unionByName(part)
        return out.groupBy("relation").agg(*[F.sum(c).alias(c) for c in ("repeated_keys", "null_keys", "orphans")])

    def _steps(self, table: str, filtering: bool):
        """(next table, relation, towards the one side) from a table."""
        for r in self.relations:
            if r.many == table and (not filtering or r.both):
                yield r.one, r, True
            if r.one == table and filtering:
                yield r.many, r, False

    def path(self, start: str, goal: str, filtering: bool = False) -> list[tuple[str, Relation, bool]]:
        """The one way from start to goal; an error if there is none or more than one."""
        found = []

        def walk(table, way, seen):
            if table == goal:
                found.append(way)
                return
            for to, r, up in self._steps(table, filtering):
                if to not in seen:
                    walk(to, way + [(to, r, up)], seen | {to})

        walk(start, [], {start})
        if len(found) != 1:
            raise ValueError(f"{len(found)} ways lead from {start} to {goal}")
        return found[0]

    def related(self, fact: str, columns: Mapping[str, str], rows: DataFrame | None = None) -> DataFrame:
        """``fact`` with columns {new name: 'table.column'} of tables on the one
        side; a row without a partner keeps nulls.  Each table is joined once."""
        out = (self.tables[fact] if rows is None else rows)
        need: dict[str, dict[str, str]] = {}
        order: list[tuple[str, Relation]] = []
        for name, ref in columns.items():
            table, c = ref.split(".")
            need.setdefault(table, {})[name] = c
            for to, r, _ in self.path(fact, table):
                if (to, r) not in order:
                    order.append((to, r))
        own = list(out.columns)
        keys = {fact: lambda c: F.col(c)}
        for to, r in order:
            later = {x.many_key for _, x in order if x.many == to}
            picked = {f"__{to}_{c}": F.col(c) for c in later} | {n: F.col(c) for n, c in need.get(to, {}).items()}
            side = self.tables[to].select(F.col(r.one_key).alias(f"__{to}"), *[c.alias(n) for n, c in picked.items()])
            out = out.join(side, keys[r.many](r.many_key) == F.col(f"__{to}"), "left").drop(f"__{to}")
            keys[to] = lambda c, t=to: F.col(f"__{t}_{c}")
        return out.select(*own, *columns)

    def filtered(self, table: str, filters: Mapping[str, Column]) -> DataFrame:
        """Rows of ``table`` under filters on any tables that lead to it."""
        out = self.tables[table]
        for source, condition in filters.items():
            held = self.tables[source].where(condition)
            if source == table:
                out = out.where(condition)
                continue
            way = self.path(source, table, filtering=True)
            for k, (to, r, up) in enumerate(way):
                mine, theirs = (r.many_key, r.one_key) if up else (r.one_key, r.many_key)
                keys = held.select(F.col(mine).alias("__k")).distinct() if up else held.select(F.col(mine).alias("__k"))
                side = out if k == len(way) - 1 else self.tables[to]
                held = side.join(keys, F.col(theirs) == F.col("__k"), "left_semi")
            out = held
        return out
