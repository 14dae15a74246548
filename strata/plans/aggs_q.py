"""Aggregation queries (A-series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import exact_sum, net_units, units, wide_sum
from strata.operators.aggregates import (best_of, count_if, dimension, kpi, kpi_cards,
                                         profile, rollup_twice, series, share_of_group,
                                         share_of_total, spread, sum_if, summary, value_counts,
                                         weekly_start, worst_label)
from strata.plans.catalog import SQL_LINEITEM_LATEST, query, sql_net_units, sql_units, table
from strata.plans.columns import PRIORITY_ORDER
from strata.plans.sales import silver_lineitem


@query("order_conditional_kpis", "A2 A5 A6 A7 A9 A1", f"""
SELECT o_orderpriority,
  count(*) AS orders, count(o_custkey) AS orders_with_customer,
  count_if(o_orderstatus = 'F') AS fulfilled,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN {sql_units('o_totalprice')} ELSE 0 END) AS DOUBLE)
     / CAST(100 AS DOUBLE) AS fulfilled_value,
  CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {sql_units('o_totalprice')} END) AS DOUBLE) / CAST(100 AS DOUBLE)
     / count(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS avg_open_value,
  avg(CAST(o_orderstatus = 'P' AS INTEGER)::DOUBLE) * 100 AS pending_rate
FROM orders GROUP BY o_orderpriority
""")
def order_conditional_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    open_price = F.when(st == "O", F.col("o_totalprice"))
    return kpi(o, ["o_orderpriority"], {
        "orders": F.count(F.lit(1)),
        "orders_with_customer": F.count("o_custkey"),
        "fulfilled": count_if(st == "F"),
        "fulfilled_value": sum_if(st == "F", units("o_totalprice"), 0) / F.lit(100.0),
        "avg_open_value": F.sum(units(open_price)) / F.lit(100.0) / F.count(open_price),
        "pending_rate": F.avg((st == "P").cast("int").cast("double")) * F.lit(100.0),
    })


@query("customer_value_rollup", "A11 D7", f"""
WITH c AS (SELECT o_custkey, sum({sql_units('o_totalprice')}) AS cust_cents, count(*) AS cust_orders
           FROM orders GROUP BY o_custkey)
SELECT customer.c_mktsegment,
  count(*) AS customers,
  CAST(sum(cust_cents) AS DOUBLE) / CAST(100 AS DOUBLE) / count(*) AS avg_customer_value,
  avg(cust_orders) AS avg_orders_per_customer,
  max(cust_orders) AS max_orders
FROM c JOIN customer ON c.o_custkey = customer.c_custkey
GROUP BY customer.c_mktsegment
""")
def customer_value_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    per = kpi(o, ["o_custkey"], {"cust_cents": F.sum(units("o_totalprice")),
                                 "cust_orders": F.count(F.lit(1))}).join(cust, "o_custkey", "inner")
    return kpi(per, ["c_mktsegment"], {
        "customers": F.count(F.lit(1)),
        "avg_customer_value": F.sum("cust_cents") / F.lit(100.0) / F.count(F.lit(1)),
        "avg_orders_per_customer": F.avg("cust_orders"),
        "max_orders": F.max("cust_orders"),
    })


@query("lineitem_global_summary", "A12 A3 A8", f"""
SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders,
  CAST(sum({sql_net_units('l_extendedprice', 'l_discount')}) AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue,
  sum(l_quantity) AS units, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem
""")
def lineitem_global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return summary(li, {
        "lines": F.count(F.lit(1)), "orders": F.countDistinct("l_orderkey"),
        "revenue": wide_sum(net_units("l_extendedprice", "l_discount")),
        "units": F.sum("l_quantity"), "first_ship": F.min("l_shipdate"), "last_ship": F.max("l_shipdate"),
    })


SQL_NATION_REVENUE = f"""
WITH li AS ({SQL_LINEITEM_LATEST}),
nr AS (
  SELECT n.n_name, c.c_mktsegment,
         CAST(sum({sql_net_units('li.l_extendedprice', 'li.l_discount')}) AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue,
         sum({sql_net_units('li.l_extendedprice', 'li.l_discount')}) AS revenue_units
  FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE li.l_quantity > 0
  GROUP BY n.n_name, c.c_mktsegment)
"""


def nation_segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = silver_lineitem(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey))
    return kpi(j, ["n_name", "c_mktsegment"], {
        "revenue": wide_sum(net_units("l_extendedprice", "l_discount")),
        "revenue_units": F.sum(net_units("l_extendedprice", "l_discount").cast("decimal(20,0)"))})


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-nation revenue re-aggregated from exact units (order-independent)."""
    nr = nation_segment_revenue(spark, sf_dir)
    return nr.groupBy("n_name").agg((F.sum("revenue_units").cast("double") / F.lit(10000.0)).alias("revenue"))


@query("nation_revenue_share", "A13 W10 J7", SQL_NATION_REVENUE + """
, t AS (SELECT n_name, CAST(sum(revenue_units) AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue FROM nr GROUP BY n_name)
SELECT n_name, round(revenue, 2) AS revenue,
       round(revenue / (SELECT sum(revenue) FROM t) * 100, 2) AS share_pct FROM t
""")
def nation_revenue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_of_total(nation_revenue(spark, sf_dir), "revenue", materialize_input=True).withColumn("revenue", F.round("revenue", 2))


@query("segment_share_in_nation", "A14 J5", SQL_NATION_REVENUE + """
SELECT n_name, c_mktsegment, revenue,
       round(revenue / sum(revenue) OVER (PARTITION BY n_name) * 100, 2) AS group_share_pct
FROM (SELECT n_name, c_mktsegment, revenue FROM nr)
""")
def segment_share_in_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nr = nation_segment_revenue(spark, sf_dir).drop("revenue_units")
    return share_of_group(nr, ["n_name"], "revenue", materialize_input=True)


@query("customer_dimension", "A15", """
SELECT DISTINCT c_mktsegment, c_nationkey FROM customer
""")
def customer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("events_weekly_start", "A17", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type,
       count(*) AS events, CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS total_value,
       count(DISTINCT user_id) AS users
FROM events GROUP BY ALL
""")
def events_weekly_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_start(table(spark, sf_dir, "events"), "ts", ["event_type"], {
        "events": F.count(F.lit(1)), "total_value": exact_sum("value"), "users": F.countDistinct("user_id")})


@query("events_hourly_series", "A19", """
SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, event_type,
       count(*) AS events, max(value) AS max_value,
       CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value) AS avg_value
FROM events GROUP BY ALL
""")
def events_hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "events"), "ts", "hour", ["event_type"], {
        "events": F.count(F.lit(1)), "max_value": F.max("value"),
        "avg_value": F.sum(units("value")) / F.lit(100.0) / F.count("value")})


@query("customer_worst_priority", "A20", """
SELECT o_custkey, max(o_orderpriority) AS max_priority_text,
  (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[
     min(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority))]
    AS worst_priority
FROM orders GROUP BY o_custkey
""")
def customer_worst_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return kpi(o, ["o_custkey"], {"max_priority_text": F.max("o_orderpriority"),
                                  "worst_priority": worst_label("o_orderpriority", PRIORITY_ORDER)})


@query("priority_value_counts", "A21", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority
""")
def priority_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("distinct_customers_by_segment", "A22 A3", """
SELECT c_mktsegment, count(DISTINCT o_custkey) AS customers, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def distinct_customers_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return kpi(o.join(c, "o_custkey"), ["c_mktsegment"], {
        "customers": F.countDistinct("o_custkey"), "orders": F.count(F.lit(1))})


@query("best_and_worst_nation", "A23", SQL_NATION_REVENUE + """
, t AS (SELECT n_name, CAST(sum(revenue_units) AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue FROM nr GROUP BY n_name)
SELECT b.n_name AS best_nation, b.revenue AS best_revenue, w.n_name AS worst_nation, w.revenue AS worst_revenue
FROM (SELECT * FROM t ORDER BY revenue DESC, n_name LIMIT 1) b,
     (SELECT * FROM t ORDER BY revenue ASC, n_name LIMIT 1) w
""")
def best_and_worst_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nation_revenue(spark, sf_dir)
    # best and worst in one aggregate pass (no join of the two single rows)
    return t.agg(best_of("n_name", "revenue").alias("best_nation"), F.max("revenue").alias("best_revenue"),
                 best_of("n_name", "revenue", worst=True).alias("worst_nation"),
                 F.min("revenue").alias("worst_revenue"))


@query("lineitem_profile", "A24 D11", """
SELECT * FROM (
  SELECT 'l_quantity' AS column, CAST(count(l_quantity) AS DOUBLE) AS count, avg(l_quantity) AS mean,
         round(stddev_samp(l_quantity), 6) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
  UNION ALL
  SELECT 'l_extendedprice', CAST(count(l_extendedprice) AS DOUBLE),
         CAST(sum(CAST(round(l_extendedprice * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(l_extendedprice),
         round(stddev_samp(l_extendedprice), 6), min(l_extendedprice), max(l_extendedprice) FROM lineitem
  UNION ALL
  SELECT 'l_discount', CAST(count(l_discount) AS DOUBLE),
         CAST(sum(CAST(round(l_discount * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(l_discount),
         round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount) FROM lineitem)
""")
def lineitem_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                   digits=6, scales={"l_extendedprice": 2, "l_discount": 2})


@query("kpi_cards_row", "A25 A12", f"""
SELECT (SELECT count(*) FROM orders) AS total_orders,
       (SELECT count(*) FROM customer) AS total_customers,
       (SELECT CAST(sum({sql_net_units('l_extendedprice', 'l_discount')}) AS DOUBLE) / CAST(10000 AS DOUBLE)
          FROM lineitem) AS gross_revenue,
       (SELECT count_if(l_returnflag = 'R') FROM lineitem) AS returned_lines,
       (SELECT count(DISTINCT user_id) FROM events) AS active_users
""")
def kpi_cards_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    li, ev = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events")
    return kpi_cards([
        (o, {"total_orders": F.count(F.lit(1))}),
        (c, {"total_customers": F.count(F.lit(1))}),
        (li, {"gross_revenue": wide_sum(net_units("l_extendedprice", "l_discount")),
              "returned_lines": count_if(F.col("l_returnflag") == "R")}),
        (ev, {"active_users": F.countDistinct("user_id")}),
    ])


@query("gold_region_rollup", "A26 A11", """
WITH g AS (SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag, count(*) AS lines, sum(l_quantity) AS qty
           FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS days, avg(lines) AS avg_daily_lines, max(qty) AS max_daily_qty,
       sum(lines) AS total_lines
FROM g GROUP BY l_returnflag
""")
def gold_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return rollup_twice(li, ["d", "l_returnflag"], {"lines": F.count(F.lit(1)), "qty": F.sum("l_quantity")},
                        ["l_returnflag"], {"days": F.count(F.lit(1)), "avg_daily_lines": F.avg("lines"),
                                           "max_daily_qty": F.max("qty"), "total_lines": F.sum("lines")})


@query("event_spread_by_type", "A4", """
SELECT event_type, count(*) AS n,
  round(stddev_samp(value), 4) AS value_stddev, min(value) AS value_min, max(value) AS value_max,
  round(max(value) - min(value), 4) AS value_range
FROM events GROUP BY event_type
""")
def event_spread_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events"), ["event_type"], ["value"])


@query("customers_daily_and_weekly", "A3 D2 A11", """
SELECT 'day' AS grain, CAST(o_orderdate AS DATE) AS start, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 2
UNION ALL SELECT 'week', CAST(date_trunc('week', o_orderdate) AS DATE), count(DISTINCT o_custkey) FROM orders GROUP BY 2
""")
def customers_daily_and_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct customers a day and a week from one scan: the days' bitmaps are written and merged."""
    from strata.operators.aggregates import count_bitmaps, distinct_bitmaps, merge_bitmaps
    from strata.session import materialize

    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("start"), "o_custkey")
    days = materialize(distinct_bitmaps(o, ["start"], "o_custkey"), "day-bitmaps")
    weeks = merge_bitmaps(days.withColumn("start", F.trunc("start", "week")), ["start"])
    grains = [count_bitmaps(b, ["start"], "customers").withColumn("grain", F.lit(g)) for g, b in (("day", days), ("week", weeks))]
    return grains[0].unionByName(grains[1]).select("grain", "start", "customers")
