"""Plan assertions: the registered queries stay JVM-side and distributed."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE

SKIP = {"stream_append_events", "stream_events_per_minute", "stream_signal_avg_5min", "stream_error_alerts"}
NAMES = sorted(n for n in E.oracle_sql() if n not in SKIP)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(node):
    """All physical plan nodes, looking through adaptive-plan wrappers."""
    out = [node]
    if node.nodeName() == "AdaptiveSparkPlan":
        return out + _nodes(node.initialPlan())
    ch = node.children()
    for i in range(ch.size()):
        out += _nodes(ch.apply(i))
    return out


def unpartitioned_windows(df):
    """Window operators without a partition spec (they run in one task).

    The distributed rank's offset pass is the one allowed case: its input is
    the per-range-partition summary (columns ``__pn``/``__pd``), at most one
    row per shuffle partition, so its size is bounded by configuration."""
    bad = []
    for n in _nodes(df._jdf.queryExecution().executedPlan()):
        if n.nodeName() == "Window" and n.partitionSpec().isEmpty():
            child_cols = n.child().output().toString()
            if "__pd" not in child_cols and "__pn" not in child_cols:
                bad.append(n.toString())
    return bad


@pytest.mark.parametrize("name", NAMES)
def test_no_python_udf_and_no_single_partition_window(spark, name):
    df = E.queries()[name](spark, SMOKE)
    plan = _plan(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert unpartitioned_windows(df) == []


def test_detector_catches_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("r", F.rank().over(Window.orderBy("id")))
    assert unpartitioned_windows(df)


def test_flagship_pushes_filters_and_prunes_columns(spark):
    from strata.plans.aggs_q import customer_dimension
    from strata.plans.windows_q import first_pending_order

    plan = _plan(first_pending_order(spark, SMOKE))
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderpriority), EqualTo(o_orderstatus,P)" in plan
    plan = _plan(customer_dimension(spark, SMOKE))
    assert "ReadSchema: struct<c_nationkey:int,c_mktsegment:string>" in plan


def test_fixed_size_dimensions_are_broadcast(spark):
    plan = _plan(E.entry(spark))
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["part_revenue_dense_rank", "nation_revenue_share", "top10_part_share"])
def test_expensive_fork_inputs_are_computed_once(spark, name):
    """Two-pass operators read a written copy of a deduplicated input, so the
    query plan itself holds no lineitem scan or dedupe aggregate (they ran
    once, in the write)."""
    df = E.queries()[name](spark, SMOKE)
    df.collect()
    p = _plan(df)
    assert "SortAggregate" not in p and "lineitem.parquet" not in p


@pytest.mark.parametrize("name", ["weekly_region_trend", "daily_sales_summary"])
def test_orders_are_counted_in_as_many_tasks_as_lineitem_needs(spark, tmp_path, monkeypatch, name):
    """Half of the lines on one order, orders and customers twice, null keys: the hot order is split where lines are
    joined, orders are counted in tasks that grow with the files, and the rows are DuckDB's."""

    import duckdb
    from pyspark.sql import functions as F

    from strata.plans import sales
    from tests.helpers import canon, rows

    i = F.col("id")
    made = {
        "lineitem": spark.range(60_000, numPartitions=4).selectExpr(
            "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 97 <> 1 THEN id % 5000 END AS l_orderkey", "id % 40 AS l_partkey", "id % 9 AS l_suppkey",
            "int(id % 40000) AS l_linenumber", "double(id % 50) AS l_quantity", "double(id % 1013) AS l_extendedprice",
            "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax", "string(id % 3) AS l_returnflag", "string(id % 2) AS l_linestatus",
            "timestamp_seconds(1500000000 + id % 700 * 86400) AS l_shipdate"),
        "orders": spark.range(4800).union(spark.range(5, 30)).select(
            i.alias("o_orderkey"), F.when(i % 13 > 0, i % 301).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
            F.lit(1.5).alias("o_totalprice"), F.timestamp_seconds(F.lit(1500000000)).alias("o_orderdate"), F.lit("LOW").alias("o_orderpriority")),
        "customer": spark.range(290).union(spark.range(5, 9)).select(
            i.alias("c_custkey"), F.lit("x").alias("c_name"), (i % 5).cast("int").alias("c_nationkey"), F.lit(0.5).alias("c_acctbal"),
            F.when(i % 3 > 0, (i % 3).cast("string")).alias("c_mktsegment")),
        "nation": spark.range(4).select(i.cast("int").alias("n_nationkey"), F.concat(F.lit("n"), "id").alias("n_name"), (i % 3).cast("int").alias("n_regionkey")),
        "region": spark.range(2).select(i.cast("int").alias("r_regionkey"), F.concat(F.lit("r"), "id").alias("r_name")),
    }
    con = duckdb.connect()
    for t, df in made.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    stored = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    monkeypatch.setattr(sales, "ORDER_BYTES", 1 << 14, raising=False)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = E.queries()[name](spark, str(tmp_path))
        got = rows(df)
        dealt = [n.outputPartitioning().numPartitions() for n in _nodes(df._jdf.queryExecution().executedPlan())
                 if n.nodeName() == "Exchange" and "REPARTITION_BY_NUM" in n.toString().split("\n")[0]]
        final = _plan(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert dealt == [-(-stored // (1 << 14))] and dealt[0] > 16
    assert "skew=true" in final
    want = con.execute(E.oracle_sql()[name])
    assert got == canon(want.fetchall(), [c[0] for c in want.description])
