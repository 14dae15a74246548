"""Operator behaviour on small hand-written frames (the FIXTURES edge rows)."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata import functions as S
from strata.operators import aggregates as A
from strata.operators import contracts as C
from strata.operators import joins as J
from strata.operators import measures as D
from strata.operators import ordering as O
from strata.operators import quality as Q
from strata.operators import windows as W
from tests.helpers import rows


def test_band_limits_and_null(spark):
    df = spark.createDataFrame([(85.0,), (84.99,), (60.0,), (40.0,), (10.0,), (None,)], "oee double")
    b = [(">=", 85, "World Class"), (">=", 60, "Acceptable"), (">=", 40, "Needs Improvement")]
    out = df.select(S.band("oee", b, "Critical").alias("a"),
                    S.band("oee", b, "Critical", null_label="Unknown").alias("b")).collect()
    assert [r.a for r in out] == ["World Class", "Acceptable", "Acceptable", "Needs Improvement",
                                  "Critical", "Critical"]
    assert out[-1].b == "Unknown"


def test_day_part_edges(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 0),) for h in (0, 7, 8, 15, 16, 23)], "ts timestamp")
    out = [r[0] for r in df.select(S.day_part("ts", [(8, "Night"), (16, "Day")], "Evening")).collect()]
    assert out == ["Night", "Night", "Day", "Day", "Evening", "Evening"]


def test_pct_zero_denominator(spark):
    df = spark.createDataFrame([(5, 0), (1, 3), (None, 2)], "n int, d int")
    out = [r[0] for r in df.select(S.pct("n", "d", 2, zero_value=0.0)).collect()]
    assert out == [0.0, 33.33, 0.0]


def test_year_week_across_year_end(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2021, 1, 3),)], "d date")
    out = df.select(S.year_week("d").alias("cal"), S.year_week("d", iso_year=True).alias("iso")).collect()
    assert out[0].cal == "2024-W01" and out[0].iso == "2025-W01"
    assert out[1].cal == "2021-W53" and out[1].iso == "2020-W53"


def test_tenure_open_end_uses_as_of(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), None), (dt.date(2024, 1, 1), dt.date(2024, 1, 11))],
                               "s date, e date")
    out = [r[0] for r in df.select(S.tenure("s", "e", as_of="2024-02-01")).collect()]
    assert out == [31, 10]


def test_rule_flag_by_type(spark):
    df = spark.createDataFrame([("heart_rate", 130.0), ("heart_rate", 70.0), ("temp", 39.5), ("other", 1e9)],
                               "t string, v double")
    out = [r[0] for r in df.select(S.rule_flag("t", "v", {"heart_rate": (50, 120), "temp": (35, 38)})).collect()]
    assert out == [True, False, True, False]


def test_tolerant_casts(spark):
    df = spark.createDataFrame([("12", "2024-01-02 03:04:05", "x", ""), ("bad", "not a time", "true", " 7 ")],
                               "a string, b string, c string, d string")
    out = Q.cast_cols(df, {"a": "int", "b": "timestamp", "c": "boolean", "d": "int"}).collect()
    assert out[0].a == 12 and out[0].b == dt.datetime(2024, 1, 2, 3, 4, 5) and out[0].c is None and out[0].d is None
    assert out[1].a is None and out[1].b is None and out[1].c is True and out[1].d == 7


def test_latest_by_keeps_latest_and_breaks_ties(spark):
    df = spark.createDataFrame([
        ("k1", 1, "a"), ("k1", 3, "b"), ("k1", 3, "c"), ("k2", None, "z"), ("k2", 0, "y")],
        "k string, ts int, v string")
    out = {r.k: (r.ts, r.v) for r in W.latest_by(df, ["k"], ["ts"]).collect()}
    assert out == {"k1": (3, "c"), "k2": (0, "y")}


def test_latest_by_is_idempotent(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    once = W.latest_by(df, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    twice = W.latest_by(once, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    assert rows(once) == rows(twice)


@pytest.mark.parametrize("method", ["rank", "dense_rank"])
def test_distributed_rank_equals_window_rank_with_hot_group(spark, method):
    # one group holds a third of the rows; many ties and NULLs
    data = [("hot", i % 7 if i % 11 else None) for i in range(300)] + \
           [(f"g{i % 13}", i % 5) for i in range(600)] + [(None, 1), (None, 1)]
    df = spark.createDataFrame(data, "g string, v int")
    ours = W.ranked(df, ["v"], ["g"], True, method, "r", num_partitions=6)
    fn = F.rank() if method == "rank" else F.dense_rank()
    ref = df.withColumn("r", fn.over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())))
    assert rows(ours) == rows(ref)


def test_global_rank_nulls_last(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 9.0)], "id int, x double")
    out = {r.id: r.rank for r in W.rank_by(df, "x").collect()}
    assert out == {4: 1, 1: 2, 3: 2, 2: 4}


def test_trend_first_period_is_null(spark):
    df = spark.createDataFrame([("L1", 1, 80.0), ("L1", 2, 83.0), ("L1", 3, 82.0), ("L2", 1, 50.0)],
                               "line string, wk int, oee double")
    out = {(r.line, r.wk): r.oee_trend for r in W.trend(df, ["line"], "wk", "oee", 2, -2).collect()}
    assert out == {("L1", 1): None, ("L1", 2): "Improving", ("L1", 3): "Stable", ("L2", 1): None}


def test_sigma_flag_single_reading_is_false(spark):
    df = spark.createDataFrame([("m1", 10.0), ("m2", 1.0), ("m2", 1.0), ("m2", 1.0), ("m2", 100.0)],
                               "m string, t double")
    out = [(r.m, r.t_anomaly) for r in W.sigma_flag(df, ["m"], "t", k=1.0).orderBy("m", "t").collect()]
    assert out[0] == ("m1", False)
    assert out[-1] == ("m2", True)


def test_share_of_total_uses_no_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    out = A.share_of_total(df, "v")
    assert {r.k: r.share_pct for r in out.collect()} == {"a": 25.0, "b": 75.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_enrich_drops_clashing_columns_and_keeps_fact_rows(spark):
    fact = spark.createDataFrame([(1, "x", 10.0), (2, "y", 20.0), (3, "z", 30.0)], "id int, name string, amt double")
    dim = spark.createDataFrame([(1, "dup", "A"), (2, "dup", "B")], "pid int, name string, cat string")
    out = J.enrich(fact, dim, ("id", "pid"), ["name", "cat"])
    assert out.columns == ["id", "name", "amt", "cat"]
    assert out.count() == 3
    assert {r.id: r.cat for r in out.collect()} == {1: "A", 2: "B", 3: None}


def test_scorecard_has_no_fanout(spark):
    dim = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    f1 = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 1.0)], "k int, v double")
    f2 = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "k int, t string")
    out = J.scorecard(dim, "k", [(f1, "k", {"s": F.sum("v")}), (f2, "k", {"n": F.count("t")})],
                      fill={"s": 0.0, "n": 0})
    assert {r.k: (r.s, r.n) for r in out.collect()} == {1: (11.0, 3), 2: (1.0, 0), 3: (0.0, 0)}


def test_orphans(spark):
    orders = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "o int, c int")
    cust = spark.createDataFrame([(10,)], "c int")
    out = J.orphans(J.edges(orders, "o", "c", "placed_by"), cust, "c").collect()
    assert [(r.src, r.dst) for r in out] == [(2, 11)]


def test_order_by_labels_and_top_k(spark):
    df = spark.createDataFrame([("3-MEDIUM", 1), ("1-URGENT", 2), ("zzz", 3), ("1-URGENT", 1)], "p string, k int")
    out = [(r.p, r.k) for r in O.order_by_labels(df, "p", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["k"]).collect()]
    assert out == [("1-URGENT", 1), ("1-URGENT", 2), ("3-MEDIUM", 1), ("zzz", 3)]
    top = [r.k for r in O.top_k(df, "k", 2, tiebreak=["p"]).collect()]
    assert top == [3, 2]


def test_worst_label_and_arg_best(spark):
    df = spark.createDataFrame([("a", "Low", 3.0), ("a", "High", 1.0), ("b", "Medium", 3.0)],
                               "k string, lab string, v double")
    w = {r.k: r.w for r in df.groupBy("k").agg(A.worst_label("lab", ["High", "Medium", "Low"]).alias("w")).collect()}
    assert w == {"a": "High", "b": "Medium"}
    best = A.arg_best(df, "k", "v").collect()[0]
    assert (best.k, best.v) == ("a", 3.0)


def test_measures_divide_alternate_and_composite(spark):
    df = spark.createDataFrame([("x", 1, 0), ("x", 0, 0), ("y", 0, 0)], "g string, a int, b int")
    spec = {"sa": D.m_sum("a"), "sb": D.m_sum("b"), "n": D.m_count(), "hits": D.m_count_where(F.col("a") == 1),
            "rate": D.m_divide("hits", "n", 100.0, alternate=0.0, digits=1),
            "bad": D.m_divide("sa", "sb", alternate=0.0),
            "flag": D.m_expr(lambda: F.when((F.col("rate") > 40) | (F.col("sa") > 5), 1).otherwise(0))}
    out = {r.g: (r.rate, r.bad, r.flag, r.hits) for r in D.measures(df, ["g"], spec).collect()}
    assert out == {"x": (50.0, 0.0, 1, 1), "y": (0.0, 0.0, 0, 0)}


def test_contract_violations_and_key_check(spark):
    df = spark.createDataFrame([(1, "5", "A"), (None, "x", "B"), (2, "500", "Z"), (2, "7", None)],
                               "id int, reading string, code string")
    contract = C.Contract({"id": C.ColumnRule(not_null=True),
                           "reading": C.ColumnRule(type="double", range=(0, 100)),
                           "code": C.ColumnRule(domain=["A", "B"]), "missing": C.ColumnRule()})
    got = {(r.column, r.rule): r.violations for r in C.violations(df, contract).collect()}
    assert got == {("id", "null"): 1, ("reading", "unparsable"): 1, ("reading", "out_of_range"): 1,
                   ("code", "not_in_domain"): 1, ("missing", "missing_column"): 4}
    k = C.check_key(df, ["id"]).collect()[0]
    assert (k.row_count, k.null_keys, k.duplicate_keys, k.key_ok) == (4, 1, 1, False)


def test_guard_label(spark):
    df = spark.createDataFrame([(i % 2,) for i in range(200)], "y int")
    assert C.guard_label(df, "y").collect()[0].passed is True
    df2 = spark.createDataFrame([(0,) for _ in range(200)], "y int")
    assert C.guard_label(df2, "y").collect()[0].passed is False
    assert C.guard_label(df2, "y", regression=True).collect()[0].passed is False


def test_profile_and_kpi_cards(spark):
    df = spark.createDataFrame([(1.0, 10.25), (3.0, 10.5)], "a double, b double")
    p = {r.column: (r["count"], r.mean, r.min, r.max) for r in A.profile(df, ["a", "b"], scales={"b": 2}).collect()}
    assert p == {"a": (2.0, 2.0, 1.0, 3.0), "b": (2.0, 10.375, 10.25, 10.5)}
    cards = A.kpi_cards([(df, {"n": F.count(F.lit(1))}), (df, {"mx": F.max("a")})]).collect()
    assert [tuple(r) for r in cards] == [(2, 3.0)]


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_do_not_depend_on_exchange_reuse(spark, reuse):
    n = 400_000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.expr("pmod(id * 7919, 400000)").alias("v"))
    key = "spark.sql.exchange.reuse"
    before = spark.conf.get(key)
    spark.conf.set(key, reuse)
    try:
        r = W.ranked(df, ["v"], (), False, "rank", "r", num_partitions=16, materialize_input=False)
        assert r.where("r <> v + 1").count() == 0
        g = W.ranked(df, ["v"], ["g"], False, "rank", "r", num_partitions=16, materialize_input=False)
        want = F.row_number().over(Window.partitionBy("g").orderBy("v"))
        assert g.withColumn("w", want).where("r <> w").count() == 0
    finally:
        spark.conf.set(key, before)


def test_wide_sum_passes_a_long(spark):
    from strata.functions import wide_sum

    df = spark.range(4).select(F.lit(2 ** 62).alias("u"))
    assert df.agg(wide_sum(F.col("u"), 0).alias("s")).first().s == float(4 * 2 ** 62)


def test_weekly_keeps_turn_of_year_weeks_together(spark):
    from strata.operators.aggregates import weekly

    df = spark.createDataFrame([("2018-01-02",), ("2018-12-31",), ("2019-01-01",)], "d string")
    assert {tuple(r) for r in weekly(df, "d", [], {"n": F.count(F.lit(1))}).collect()} == {(2018, 1, 1), (2019, 1, 2)}


def test_hot_key_join_backs_are_split(spark):
    """Half of the rows on one key: AQE splits it at the join back."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    path = tempfile.mkdtemp() + "/x"
    spark.range(400_000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000).alias("k"), F.rand(1).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    from strata.operators.joins import with_group_stats
    from strata.streaming import sigma_outliers

    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for out in (W.sigma_flag(df, ["k"], "v"), W.repeat_flag(df, "k"), sigma_outliers(df, "k", "v"),
                    with_group_stats(df, ["k"], {"m": F.avg("v")})):
            out.write.format("noop").mode("overwrite").save()
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
