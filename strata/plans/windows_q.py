"""Window-style queries (W-series) and ordering (O-series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import net_units
from strata.operators.aggregates import kpi
from strata.operators.ordering import first_match, limit_rows, order_by_labels, top_share
from strata.operators.windows import (dense_rank_by, drop_duplicates, lag_features, latest_by, rank_by,
                                      rank_in, repeat_flag, sigma_flag)
from strata.plans.catalog import SQL_LINEITEM_LATEST, query, sql_net_units, table
from strata.plans.columns import PRIORITY_ORDER
from strata.plans.sales import LINE_KEY


@query("lineitem_latest_per_line", "W1 S12", SQL_LINEITEM_LATEST)
def lineitem_latest_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "lineitem"), LINE_KEY, ["l_shipdate"])


@query("lineitem_any_per_line", "W2", """
SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
""")
def lineitem_any_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    # any row per key is kept; only the key set is deterministic, so compare that
    return drop_duplicates(table(spark, sf_dir, "lineitem"), LINE_KEY).select(*LINE_KEY)


SQL_PART_REVENUE = f"""
WITH li AS (SELECT * FROM ({SQL_LINEITEM_LATEST}) WHERE l_quantity > 0),
p AS (SELECT l_partkey,
             CAST(sum({sql_net_units('l_extendedprice', 'l_discount')}) AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue,
             sum(l_quantity) AS units
      FROM li GROUP BY l_partkey)
"""


def part_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.plans.sales import silver_lineitem

    return kpi(silver_lineitem(spark, sf_dir), ["l_partkey"], {
        "revenue": F.sum(net_units("l_extendedprice", "l_discount")) / F.lit(10000.0),
        "units": F.sum("l_quantity")})


@query("part_revenue_dense_rank", "W3", SQL_PART_REVENUE + """
SELECT *, CAST(dense_rank() OVER (ORDER BY units DESC) AS BIGINT) AS units_rank FROM p
""")
def part_revenue_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_rank_by(part_revenue(spark, sf_dir), "units", name="units_rank")


@query("customer_value_rank", "W4 J1", """
WITH o AS (SELECT o_custkey, max(o_totalprice) AS best_order FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, best_order,
       CAST(rank() OVER (ORDER BY best_order DESC NULLS LAST) AS BIGINT) AS value_rank
FROM customer LEFT JOIN o ON c_custkey = o_custkey
""")
def customer_value_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
         .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best_order")))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return rank_by(c, "best_order", name="value_rank")


@query("customer_rank_in_nation", "W5", """
SELECT c_custkey, c_nationkey, c_acctbal,
       CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) AS BIGINT) AS nation_rank,
       CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC NULLS LAST) AS BIGINT)
         AS nation_in_segment
FROM customer
""")
def customer_rank_in_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    r = rank_in(c, ["c_nationkey"], "c_acctbal", name="nation_rank", materialize_input=False)  # plain scan
    r = rank_in(r, ["c_mktsegment"], "c_nationkey", name="nation_in_segment", method="dense_rank")
    return r.select("c_custkey", "c_nationkey", "c_acctbal", "nation_rank", "nation_in_segment")


@query("event_type_daily_lags", "W6 A19", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY ALL)
SELECT *, lag(events, 1) OVER w AS events_lag_1, lag(events, 7) OVER w AS events_lag_7
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)
""")
def event_type_daily_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = kpi(e, ["event_type", F.to_date("ts").alias("day")], {"events": F.count(F.lit(1))})
    return lag_features(d, ["event_type"], "day", {"events": [1, 7]})


@query("event_sigma_flags", "W8 J5", """
WITH st AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value,
       coalesce(abs(e.value - st.m) > 2 * st.sd, false) AS value_anomaly
FROM events e LEFT JOIN st USING (event_type)
""")
def event_sigma_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sigma_flag(e, ["event_type"], "value", k=2.0)


@query("repeat_customer_orders", "W9", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o.o_custkey, CAST(c.n > 1 AS INTEGER) AS is_repeat
FROM orders o LEFT JOIN c USING (o_custkey)
""")
def repeat_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return repeat_flag(o, "o_custkey")


@query("orders_by_priority_label", "O1 O2", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'P'
""")
def orders_by_priority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    return order_by_labels(o.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority",
                           PRIORITY_ORDER, then=["o_orderkey"])


@query("first_orders_sample", "O4", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100
""")
def first_orders_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row sample is the feature here (the reference's explore step)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return limit_rows(o, 100, ["o_orderkey"])


@query("first_pending_order", "O5", """
SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 1
""")
def first_pending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return first_match(o, (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"),
                       "o_orderkey")


@query("top10_part_share", "O6 D5 W3", f"""
WITH li AS (SELECT * FROM ({SQL_LINEITEM_LATEST}) WHERE l_quantity > 0),
p AS (SELECT l_partkey, CAST(sum({sql_net_units('l_extendedprice', 'l_discount')}) AS DOUBLE) AS u
      FROM li GROUP BY l_partkey),
r AS (SELECT *, dense_rank() OVER (ORDER BY u DESC) AS rk FROM p),
t AS (SELECT sum(CASE WHEN rk <= 10 THEN u ELSE 0.0 END) AS top_u, sum(u) AS total_u FROM r)
SELECT top_u / CAST(10000 AS DOUBLE) AS top_value, total_u / CAST(10000 AS DOUBLE) AS total_value,
       round(top_u / total_u * 100, 2) AS top_share_pct
FROM t
""")
def top10_part_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.plans.sales import silver_lineitem

    # revenue in exact 1/10000 units; the share is a ratio of exact totals
    li = silver_lineitem(spark, sf_dir).withColumn("net", net_units("l_extendedprice", "l_discount"))
    out = top_share(li, "l_partkey", "net", 10)
    return out.select((F.col("top_value") / F.lit(10000.0)).alias("top_value"),
                      (F.col("total_value") / F.lit(10000.0)).alias("total_value"), "top_share_pct")


@query("event_value_lags", "W6 W7", """
SELECT event_id, user_id, lag(value, 1) OVER w AS prev_value, lag(value, 7) OVER w AS value_7_back, lag(ts, 1) OVER w AS prev_ts
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def event_value_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags by ranges with a halo: a user may hold any share of the events."""
    from strata.operators.windows import lag_ranged

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return lag_ranged(e, ["user_id"], ["ts", "event_id"], {"prev_value": ("value", 1), "value_7_back": ("value", 7), "prev_ts": ("ts", 1)}).select(
        "event_id", "user_id", "prev_value", "value_7_back", "prev_ts")
