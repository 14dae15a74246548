"""Relationship model, ranged lags, mergeable distinct counts, exact totals."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators.aggregates import count_bitmaps, distinct_bitmaps, merge_bitmaps
from strata.operators.measures import auto_measures
from strata.operators.model import Model, Relation
from strata.operators.ordering import top_share
from strata.operators.windows import lag_ranged
from tests.helpers import rows


def _model(spark, both):
    fact = spark.createDataFrame([(1, 10, 100), (2, 10, 101), (3, 11, 100), (4, None, 102), (5, 99, 100)], "id int, a int, b int")
    a = spark.createDataFrame([(10, "x", 1), (11, "y", 2), (12, "z", 1)], "a_id int, a_name string, g int")
    g = spark.createDataFrame([(1, "one"), (2, "two")], "g_id int, g_name string")
    b = spark.createDataFrame([(100, "p"), (101, "q"), (102, "r"), (103, "s")], "b_id int, b_name string")
    return Model({"fact": fact, "a": a, "g": g, "b": b}, [
        Relation("fact", "a", "a", "a_id"), Relation("a", "g", "g", "g_id"), Relation("fact", "b", "b", "b_id", both=both)])


def test_columns_follow_the_relations(spark):
    got = _model(spark, True).related("fact", {"name": "a.a_name", "group": "g.g_name", "bn": "b.b_name"})
    assert got.columns == ["id", "a", "b", "name", "group", "bn"]
    by = {r.id: (r.name, r.group, r.bn) for r in got.collect()}
    assert by == {1: ("x", "one", "p"), 2: ("x", "one", "q"), 3: ("y", "two", "p"), 4: (None, None, "r"), 5: (None, None, "p")}


def test_filters_travel_to_the_many_side_and_back_only_where_declared(spark):
    m = _model(spark, True)
    assert {r.id for r in m.filtered("fact", {"g": F.col("g_name") == "one"}).collect()} == {1, 2}
    assert {r.id for r in m.filtered("fact", {"g": F.col("g_name") == "one", "b": F.col("b_name") == "p"}).collect()} == {1}
    assert {r.b_name for r in m.filtered("b", {"g": F.col("g_name") == "one"}).collect()} == {"p", "q"}
    with pytest.raises(ValueError):
        m.filtered("a", {"b": F.col("b_name") == "p"})  # fact to a is one-way
    with pytest.raises(ValueError):
        _model(spark, False).filtered("b", {"g": F.col("g_name") == "one"})


def test_relation_check(spark):
    m = _model(spark, True)
    bad = spark.createDataFrame([(10, "x", 1), (10, "again", 1), (None, "n", 7), (None, "n", 1)], "a_id int, a_name string, g int")
    got = {r.relation: tuple(r)[1:] for r in Model(m.tables | {"a": bad}, m.relations).check().collect()}
    assert got == {"fact.a -> a.a_id": (1, 2, 2), "a.g -> g.g_id": (0, 0, 1), "fact.b -> b.b_id": (0, 0, 0)}
    with pytest.raises(ValueError):
        Model(m.tables, [Relation("fact", "none", "a", "a_id")])


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_ranged_lags_equal_the_window(spark, parts):
    rnd = random.Random(parts)
    data = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None, "c"]), t, rnd.choice([None, float(t)]))
            for t in range(400)] + [("rare", 1000, 1.0)]
    df = spark.createDataFrame(data, "k string, t int, v double").withColumn("other", F.lit(1))
    lags = {"p1": ("v", 1), "p7": ("v", 7), "t2": ("t", 2)}
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("*", *[F.lag(c, n).over(w).alias(x) for x, (c, n) in lags.items()])
    got = lag_ranged(df, ["k"], ["t"], lags, num_partitions=parts)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert lag_ranged(df.limit(0), ["k"], ["t"], lags).collect() == []


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id", F.col("id").alias("v"))
    got = lag_ranged(df, ["k"], ["id"], {"p": ("v", 1)}, num_partitions=16)
    assert got.where("k = 0").agg(F.count_if(F.col("p") == F.col("v") - 2)).first()[0] == 19_999
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 30_000


def test_bitmaps_merge_to_exact_counts(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.randint(0, 20), rnd.choice([rnd.randint(0, 99), rnd.randint(0, 10 ** 12), None])) for _ in range(2000)], "d int, c long")
    days = distinct_bitmaps(df, ["d"], "c")
    assert rows(count_bitmaps(days, ["d"], "n")) == rows(df.groupBy("d").agg(F.countDistinct("c").alias("n")))
    weeks = merge_bitmaps(days.withColumn("d", F.floor(F.col("d") / 7)), ["d"])
    assert rows(count_bitmaps(weeks, ["d"], "n")) == rows(df.groupBy(F.floor(F.col("d") / 7).alias("d")).agg(F.countDistinct("c").alias("n")))


def test_totals_beyond_a_long_and_a_double(spark):
    df = spark.createDataFrame([(9 * 10 ** 18, 1)] * 4, "big long, one int")
    assert auto_measures(df).first().asDict() == {"row_count": 4, "total_big": 36 * 10 ** 18, "total_one": 4}
    units = spark.createDataFrame([("a", 2 ** 53), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 2)], "k string, u long")
    assert top_share(units, "k", "u", 1).first().total_value == float(2 ** 53 + 6)


def test_check_deals_keys_by_the_size_of_the_one_side(spark, monkeypatch, tmp_path):
    """Small shuffled keys are not put together into few tasks; rows are those of the plain plan."""
    from strata.operators import model as M

    one = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 4000).alias("k"))
    many = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("f"))
    one.write.parquet(f"{tmp_path}/one a")
    many.write.parquet(f"{tmp_path}/many")
    m = M.Model({"one": spark.read.parquet(f"{tmp_path}/one a"), "many": spark.read.parquet(f"{tmp_path}/many")},
                [M.Relation("many", "f", "one", "k")])
    plain = sorted(map(tuple, m.check().collect()))
    monkeypatch.setattr(M, "KEY_BYTES", 2048)
    check = m.check()
    assert sorted(map(tuple, check.collect())) == plain and plain[0][1] > 0 and plain[0][2] == 100 and plain[0][3] > 0
    plan = check._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
