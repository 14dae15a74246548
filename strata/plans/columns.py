"""Scalar-expression queries (P-series, A18, calendar functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import (amount_if, any_flag, band, day_part, deviation, flag, health_score,
                              is_weekend, map_category, matrix_band, pct, prefix_group, row_mean,
                              rule_flag, tenure, units, weekday_monday0, weighted_score, worst_of,
                              year_week, oee_parts, oee)
from strata.operators.quality import cast_cols, fill_features, keep_in, scrub_numeric, within
from strata.plans.catalog import query, sql_units, table

AS_OF = "2002-01-01"  # fixed reference date so ages are reproducible

# Order priority groups and value bands used by these queries.
PRIORITY_GROUPS = {"Urgent": ["1-URGENT", "2-HIGH"], "Normal": ["3-MEDIUM"]}
PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("order_value_bands", "P10 P12 P13 P19 P24 P25 P29 F", f"""
SELECT o_orderkey,
  CASE WHEN o_totalprice >= 300000 THEN 'Large' WHEN o_totalprice >= 100000 THEN 'Medium'
       ELSE 'Small' END AS value_band,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Urgent'
       WHEN o_orderpriority IN ('3-MEDIUM') THEN 'Normal' ELSE 'Low' END AS urgency,
  CAST(coalesce(o_orderstatus = 'O', false) AS INTEGER) AS is_open,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER) AS age_days,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS completed_value,
  substring(o_orderpriority, 1, 1) AS priority_code,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week,
  CAST((dayofweek(o_orderdate) + 6) % 7 AS INTEGER) AS weekday_mon0,
  dayofweek(o_orderdate) IN (0, 6) AS is_weekend,
  CAST(month(o_orderdate) AS INTEGER) AS order_month,
  CAST(dayofmonth(o_orderdate) AS INTEGER) AS order_dom
FROM orders
""")
def order_value_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        band("o_totalprice", [(">=", 300000, "Large"), (">=", 100000, "Medium")], "Small").alias("value_band"),
        map_category("o_orderpriority", PRIORITY_GROUPS, "Low").alias("urgency"),
        flag(F.col("o_orderstatus") == "O").alias("is_open"),
        tenure("o_orderdate", as_of=AS_OF).alias("age_days"),
        amount_if(F.col("o_orderstatus") == "F", "o_totalprice").alias("completed_value"),
        prefix_group("o_orderpriority", 1).alias("priority_code"),
        F.dayofweek("o_orderdate").alias("day_of_week"),
        weekday_monday0("o_orderdate").alias("weekday_mon0"),
        is_weekend("o_orderdate").alias("is_weekend"),
        F.month("o_orderdate").alias("order_month"),
        F.dayofmonth("o_orderdate").alias("order_dom"),
    )


# Per-event-type physical limits (P14) and the nominal signal.
EVENT_LIMITS = {"purchase": (1.0, 45.0), "view": (None, 40.0), "error": (5.0, None)}
NOMINAL_VALUE = 25.0


@query("event_readings_silver", "P5 P9 P11 P13 P14 P15 P21 F", """
WITH e AS (SELECT * FROM events WHERE value BETWEEN 0 AND 1000),
s AS (
  SELECT event_id, user_id, event_type, value,
    CASE WHEN hour(ts) < 8 THEN 'Night' WHEN hour(ts) < 16 THEN 'Day' ELSE 'Evening' END AS shift,
    CAST(hour(ts) AS INTEGER) AS reading_hour,
    coalesce(CASE WHEN event_type = 'purchase' THEN (value < 1.0 OR value > 45.0)
                  WHEN event_type = 'view' THEN value > 40.0
                  WHEN event_type = 'error' THEN value < 5.0
                  ELSE false END, false) AS out_of_range,
    abs(value - 25.0) AS deviation,
    TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS INTEGER) AS k
  FROM e)
SELECT *, (out_of_range OR event_type = 'error' OR value > 45) AS high_risk,
  CAST(coalesce(k > 50, false) AS INTEGER) AS k_high
FROM s
""")
def event_readings_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = within(table(spark, sf_dir, "events"), {"value": (0, 1000)})
    e = cast_cols(e.withColumn("k", F.get_json_object("props", "$.k")), {"k": "int"})
    s = e.select(
        "event_id", "user_id", "event_type", "value",
        day_part("ts", [(8, "Night"), (16, "Day")], "Evening").alias("shift"),
        F.hour("ts").alias("reading_hour"),
        rule_flag("event_type", "value", EVENT_LIMITS).alias("out_of_range"),
        deviation("value", NOMINAL_VALUE).alias("deviation"),
        "k",
    )
    return s.withColumns({
        "high_risk": any_flag([F.col("out_of_range"), F.col("event_type") == "error", F.col("value") > 45]),
        "k_high": flag(F.col("k") > 50),
    })


# Additive risk weights (P16) and the score bands.
RISK_WEIGHTS = [("high_discount", 30), ("returned", 25), ("bulk", 20), ("high_tax", 10)]


@query("line_risk_score", "P13 P16 P10 P22 P7", f"""
WITH l AS (
  SELECT l_orderkey, l_linenumber, l_shipdate,
    l_discount >= 0.08 AS high_discount, l_returnflag = 'R' AS returned,
    l_quantity >= 40 AS bulk, l_tax >= 0.06 AS high_tax,
    round((l_quantity + l_discount * 100 + l_tax * 100) / 3.0, 2) AS mean_score
  FROM lineitem WHERE l_linestatus IN ('O', 'F'))
SELECT *, s AS risk_score,
  CASE WHEN s >= 50 THEN 'High' WHEN s >= 25 THEN 'Medium' ELSE 'Low' END AS risk_band
FROM (SELECT *, coalesce(CAST(high_discount AS INTEGER), 0) * 30 + coalesce(CAST(returned AS INTEGER), 0) * 25
              + coalesce(CAST(bulk AS INTEGER), 0) * 20 + coalesce(CAST(high_tax AS INTEGER), 0) * 10 AS s
      FROM l)
""")
def line_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = keep_in(table(spark, sf_dir, "lineitem"), "l_linestatus", ["O", "F"])
    l = li.select(
        "l_orderkey", "l_linenumber", "l_shipdate",
        (F.col("l_discount") >= 0.08).alias("high_discount"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_quantity") >= 40).alias("bulk"),
        (F.col("l_tax") >= 0.06).alias("high_tax"),
        row_mean([F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100], 2).alias("mean_score"),
    )
    s = weighted_score(RISK_WEIGHTS)
    return l.withColumns({"s": s, "risk_score": s}).withColumn(
        "risk_band", band("s", [(">=", 50, "High"), (">=", 25, "Medium")], "Low"))


@query("event_health_daily", "A4 A5 P17 P10 W8 J5 M3", """
WITH st AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id),
s AS (SELECT e.*, coalesce(abs(e.value - st.m) > 2 * st.sd, false) AS anomaly
      FROM events e LEFT JOIN st USING (user_id)),
g AS (
  SELECT CAST(ts AS DATE) AS reading_date, user_id,
    count(*) AS reading_count,
    CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value) AS avg_value,
    count_if(anomaly) AS anomaly_count,
    round(stddev_samp(value), 6) AS value_stddev,
    min(value) AS min_value, max(value) AS max_value,
    max(value) - min(value) AS value_range
  FROM s GROUP BY ALL)
SELECT *, anomaly_count / reading_count * 100 AS anomaly_rate,
  round(greatest(0.0, 100.0 - anomaly_count / reading_count * 100 * 5 - coalesce(value_stddev, 0.0) * 0.3), 1)
    AS health_score
FROM g
""")
def event_health_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.operators.windows import sigma_flag

    e = sigma_flag(table(spark, sf_dir, "events"), ["user_id"], "value", k=2.0, name="anomaly")
    g = (e.groupBy(F.to_date("ts").alias("reading_date"), "user_id")
         .agg(F.count(F.lit(1)).alias("reading_count"),
              (F.sum(units("value")) / F.lit(100.0) / F.count("value")).alias("avg_value"),
              F.count_if("anomaly").alias("anomaly_count"),
              F.round(F.stddev("value"), 6).alias("value_stddev"),
              F.min("value").alias("min_value"), F.max("value").alias("max_value"),
              (F.max("value") - F.min("value")).alias("value_range")))
    g = g.withColumn("anomaly_rate", pct("anomaly_count", "reading_count", digits=None))
    return g.withColumn("health_score", health_score(100.0, [("anomaly_rate", 5.0), ("value_stddev", 0.3)]))


@query("order_year_week", "A18 A1 F", f"""
SELECT concat_ws('-W', CAST(year(o_orderdate) AS VARCHAR), lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0'))
         AS year_week,
       count(*) AS orders,
       CAST(sum({sql_units('o_totalprice')}) AS DOUBLE) / CAST(100 AS DOUBLE) AS total_value
FROM orders GROUP BY 1
""")
def order_year_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(year_week("o_orderdate").alias("year_week"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 (F.sum(units("o_totalprice")) / F.lit(100.0)).alias("total_value")))


@query("supplier_matrix_band", "P18 P10 J6", """
WITH s AS (
  SELECT l_suppkey, count(*) AS lines,
         avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100 AS return_rate,
         avg(l_quantity) AS avg_qty
  FROM lineitem GROUP BY l_suppkey)
SELECT supplier.s_suppkey, lines, return_rate, avg_qty,
  CASE WHEN return_rate >= 30 AND avg_qty < 25 THEN 'Critical'
       WHEN return_rate >= 25 OR avg_qty < 24 THEN 'Watch'
       WHEN lines IS NULL THEN 'Unknown' ELSE 'Good' END AS performance,
  CASE WHEN return_rate >= 30 THEN 'High' WHEN return_rate >= 20 THEN 'Medium'
       WHEN return_rate IS NULL THEN 'Unknown' ELSE 'Low' END AS return_band,
  CASE WHEN avg_qty < 24 THEN 'High' WHEN avg_qty < 26 THEN 'Medium'
       WHEN avg_qty IS NULL THEN 'Unknown' ELSE 'Low' END AS volume_band,
  CASE WHEN 'High' IN (return_band_, volume_band_) THEN 'High'
       WHEN 'Medium' IN (return_band_, volume_band_) THEN 'Medium'
       WHEN 'Low' IN (return_band_, volume_band_) THEN 'Low' ELSE 'Unknown' END AS worst_band
FROM supplier LEFT JOIN s ON supplier.s_suppkey = s.l_suppkey,
LATERAL (SELECT
  CASE WHEN return_rate >= 30 THEN 'High' WHEN return_rate >= 20 THEN 'Medium'
       WHEN return_rate IS NULL THEN 'Unknown' ELSE 'Low' END AS return_band_,
  CASE WHEN avg_qty < 24 THEN 'High' WHEN avg_qty < 26 THEN 'Medium'
       WHEN avg_qty IS NULL THEN 'Unknown' ELSE 'Low' END AS volume_band_)
""")
def supplier_matrix_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.operators.joins import scorecard

    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey")
    sc = scorecard(sup, "s_suppkey", [(li, "l_suppkey", {
        "lines": F.count(F.lit(1)),
        "return_rate": F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)) * F.lit(100.0),
        "avg_qty": F.avg("l_quantity"),
    })])
    rr, aq = F.col("return_rate"), F.col("avg_qty")
    return sc.withColumns({
        "performance": matrix_band([((rr >= 30) & (aq < 25), "Critical"),
                                    ((rr >= 25) | (aq < 24), "Watch"),
                                    (F.col("lines").isNull(), "Unknown")], "Good"),
        "return_band": band(rr, [(">=", 30, "High"), (">=", 20, "Medium")], "Low", null_label="Unknown"),
        "volume_band": band(aq, [("<", 24, "High"), ("<", 26, "Medium")], "Low", null_label="Unknown"),
    }).withColumn("worst_band", worst_of(["return_band", "volume_band"], ["High", "Medium", "Low"], "Unknown"))


@query("customer_fill_scrub", "P26 P27 J1", """
WITH o AS (SELECT o_custkey, count(*) AS order_count, max(o_totalprice) AS max_order FROM orders GROUP BY o_custkey),
n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0)
SELECT c.c_custkey,
  coalesce(n.n_name, 'unknown') AS n_name,
  coalesce(o.order_count, 0) AS order_count,
  CASE WHEN o.max_order IS NULL OR isnan(o.max_order) THEN 0.0 ELSE o.max_order END AS max_order,
  CASE WHEN c.c_acctbal IS NULL OR isnan(c.c_acctbal) THEN 0.0 ELSE c.c_acctbal END AS c_acctbal
FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey
LEFT JOIN n ON c.c_nationkey = n.n_nationkey
""")
def customer_fill_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.operators.joins import enrich

    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.count(F.lit(1)).alias("order_count"), F.max("o_totalprice").alias("max_order")))
    n = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 0)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    j = enrich(enrich(c, o, ("c_custkey", "o_custkey")), n, ("c_nationkey", "n_nationkey"), ["n_name"],
               fixed_size=True)
    j = fill_features(j, categorical=["n_name"], numeric=["order_count"])
    j = scrub_numeric(j.select("c_custkey", "n_name", "order_count", "max_order", "c_acctbal"),
                      exclude=["c_custkey", "order_count"])
    return j


@query("oee_by_priority", "P23 A1 P19", f"""
WITH g AS (
  SELECT o_orderpriority, count(*) AS batch_count,
    sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS produced,
    sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS planned,
    sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS defects,
    sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) * 60 AS downtime
  FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, CAST(batch_count AS BIGINT) AS batch_count, CAST(produced AS BIGINT) AS produced,
  CAST(planned AS BIGINT) AS planned, CAST(defects AS BIGINT) AS defects, CAST(downtime AS BIGINT) AS downtime,
  a AS availability, p AS performance, q AS quality, round(a * p * q * 100, 2) AS oee
FROM (SELECT *, round(1 - downtime / (batch_count * 480), 4) AS a, round(produced / nullif(planned, 0), 4) AS p,
             round((produced - defects) / nullif(produced, 0), 4) AS q FROM g)
""")
def oee_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OEE on orders: status F = good output, O = defects, P = downtime (60 min each)."""
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    g = o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("batch_count"),
        F.sum(F.when(st == "F", 1).otherwise(0)).cast("long").alias("produced"),
        F.sum(F.when(st != "P", 1).otherwise(0)).cast("long").alias("planned"),
        F.sum(F.when(st == "O", 1).otherwise(0)).cast("long").alias("defects"),
        (F.sum(F.when(st == "P", 1).otherwise(0)) * 60).cast("long").alias("downtime"))
    parts = oee_parts("downtime", "batch_count", "produced", "planned", "defects")
    g = g.withColumns(parts)
    return g.withColumn("oee", oee(F.col("availability"), F.col("performance"), F.col("quality")))
