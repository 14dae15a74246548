"""Join queries (J-series) and source/sink queries (S-series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import exact_sum, units
from strata.operators.aggregates import kpi
from strata.operators.joins import (edges, enrich, enrich_as, label_from_events, orphans, scorecard,
                                    with_group_stats)
from strata.plans.catalog import query, sql_exact_sum, sql_net_units, sql_units, table
from strata.sources import (audit_counts, bronze_stamp, capped_load, cast_by_spec, create_view, infer_types,
                            parse_events, read_path, run_spec_query, string_widths)


@query("orders_enriched_customer", "J1 J10", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_mktsegment, c.c_acctbal
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def orders_enriched_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    # the customer side carries an o_totalprice clash on purpose: enrich drops it
    c = table(spark, sf_dir, "customer").withColumn("o_totalprice", F.lit(0.0))
    return enrich(o, c, ("o_custkey", "c_custkey"), ["c_name", "c_mktsegment", "c_acctbal", "o_totalprice"])


@query("lines_with_partsupp_stats", "J3 J5 A1", """
WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS ps_lines, sum(l_quantity) AS ps_qty
           FROM lineitem GROUP BY l_partkey, l_suppkey),
g AS (SELECT l_partkey, avg(l_quantity) AS part_avg_qty FROM lineitem GROUP BY l_partkey)
SELECT li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey, li.l_quantity, s.ps_lines, s.ps_qty,
       g.part_avg_qty
FROM lineitem li LEFT JOIN s ON li.l_partkey = s.l_partkey AND li.l_suppkey = s.l_suppkey
LEFT JOIN g ON li.l_partkey = g.l_partkey
""")
def lines_with_partsupp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_quantity")
    ps = kpi(li, ["l_partkey", "l_suppkey"], {"ps_lines": F.count(F.lit(1)), "ps_qty": F.sum("l_quantity")})
    out = enrich(li, ps, ["l_partkey", "l_suppkey"])
    return with_group_stats(out, ["l_partkey"], {"part_avg_qty": F.avg("l_quantity")})


@query("customer_scorecard", "J6 M4 A1", f"""
WITH o AS (SELECT o_custkey, count(*) AS orders, CAST(sum({sql_units('o_totalprice')}) AS DOUBLE) / CAST(100 AS DOUBLE)
                  AS order_value FROM orders GROUP BY o_custkey),
l AS (SELECT o.o_custkey, count(*) AS lines, count_if(li.l_returnflag = 'R') AS returned_lines
      FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey GROUP BY o.o_custkey)
SELECT c.c_custkey, c.c_mktsegment, coalesce(o.orders, 0) AS orders, coalesce(o.order_value, 0.0) AS order_value,
       coalesce(l.lines, 0) AS lines, coalesce(l.returned_lines, 0) AS returned_lines
FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey LEFT JOIN l ON c.c_custkey = l.o_custkey
""")
def customer_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"),
                                               "l_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return scorecard(c, "c_custkey", [
        (o, "o_custkey", {"orders": F.count(F.lit(1)),
                          "order_value": F.sum(units("o_totalprice")) / F.lit(100.0)}),
        (li, "o_custkey", {"lines": F.count(F.lit(1)),
                           "returned_lines": F.count_if(F.col("l_returnflag") == "R")}),
    ], fill={"orders": 0, "order_value": 0.0, "lines": 0, "returned_lines": 0})


@query("sql_view_urgent_revenue", "J7 S10 S9", f"""
SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS lines,
       CAST(sum({sql_net_units('li.l_extendedprice', 'li.l_discount')}) AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue,
       CAST(sum(CASE WHEN li.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')
GROUP BY c.c_mktsegment, o.o_orderpriority
""")
def sql_view_urgent_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 spec query + S10 reporting view: SQL text over registered tables."""
    spec = {
        "tables": {"li_v": f"{sf_dir}/lineitem.parquet", "o_v": f"{sf_dir}/orders.parquet",
                   "c_v": f"{sf_dir}/customer.parquet"},
        "sql": """
          SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS lines,
                 sum((CAST(round(li.l_extendedprice * 100.0) AS BIGINT)
                      * (100 - CAST(round(li.l_discount * 100.0) AS BIGINT)))) / CAST(10000 AS DOUBLE) AS revenue,
                 CAST(sum(CASE WHEN li.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
          FROM li_v li JOIN o_v o ON li.l_orderkey = o.o_orderkey JOIN c_v c ON o.o_custkey = c.c_custkey
          GROUP BY c.c_mktsegment, o.o_orderpriority""",
    }
    base = run_spec_query(spark, spec)
    return create_view(spark, "urgent_revenue_v",
                       "SELECT * FROM (" + spec["sql"] + ") WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")


@query("orders_status_from_named_table", "S4 A1", f"""
SELECT o_orderstatus, count(*) AS orders, {sql_exact_sum('o_totalprice')} AS total_price
FROM orders GROUP BY o_orderstatus
""")
def orders_status_from_named_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bronze layer is registered under a name and the next layer
    reads it by that name, not by path (the plan is the same parquet scan)."""
    from strata.sources import read_table

    table(spark, sf_dir, "orders").createOrReplaceTempView("bronze_orders")
    o = read_table(spark, "bronze_orders")
    return kpi(o, ["o_orderstatus"], {"orders": F.count(F.lit(1)), "total_price": exact_sum("o_totalprice")})


@query("customer_return_label", "J9 M5", """
WITH r AS (SELECT DISTINCT o.o_custkey FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
           WHERE li.l_returnflag = 'R')
SELECT c.c_custkey, c.c_mktsegment, CASE WHEN r.o_custkey IS NULL THEN 0 ELSE 1 END AS had_return
FROM customer c LEFT JOIN r ON c.c_custkey = r.o_custkey
""")
def customer_return_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ret = (table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
           .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
           .select(F.col("o_custkey").alias("c_custkey")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return label_from_events(c, ret, ["c_custkey"], "had_return")


@query("domestic_lines_by_nation", "J11 J4", """
SELECT cn.n_name AS cust_n_name, count(*) AS lines,
       count_if(sn.n_name = cn.n_name) AS domestic_lines
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON li.l_suppkey = s.s_suppkey
LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
GROUP BY cn.n_name
""")
def domestic_lines_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    f = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(s, li.l_suppkey == s.s_suppkey))
    # the same nation dimension in two roles
    f = enrich_as(f, nation, "c_nationkey", "n_nationkey", "cust_", ["n_name"])
    f = enrich_as(f, nation, "s_nationkey", "n_nationkey", "supp_", ["n_name"])
    return kpi(f, ["cust_n_name"], {"lines": F.count(F.lit(1)),
                                    "domestic_lines": F.count_if(F.col("supp_n_name") == F.col("cust_n_name"))})


@query("order_customer_edges", "J13 C6", """
SELECT DISTINCT o_orderkey AS src, o_custkey AS dst, 'placed_by' AS relationship
FROM orders WHERE o_custkey IS NOT NULL
""")
def order_customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "placed_by")


@query("orphan_order_edges", "J13", """
WITH e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey IS NOT NULL),
keep AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
SELECT e.dst, e.src, 'placed_by' AS relationship FROM e
WHERE NOT EXISTS (SELECT 1 FROM keep WHERE keep.c_custkey = e.dst)
""")
def orphan_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # entity set = customers in good standing; orders of the others are orphans
    cust = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
    return orphans(edges(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "placed_by"),
                   cust, "c_custkey")


# ------------------------------------------------------------------ sources
@query("bronze_orders_batch", "S3 S8", """
SELECT *, 'batch-001' AS batch_id FROM orders
""")
def bronze_orders_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_path(spark, f"{sf_dir}/orders.parquet")
    # ingestion time and file path are run-dependent: stamped, then left out of the comparison
    return bronze_stamp(df, "batch-001").drop("ingestion_timestamp", "source_file")


@query("customer_capped_dedupe", "S12 O4", """
SELECT * EXCLUDE (__rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey
                               ORDER BY c_custkey, c_name, c_acctbal) AS __rn FROM customer)
WHERE __rn = 1
""")
def customer_capped_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", "c_name", "c_acctbal")
    return capped_load(c, ["c_mktsegment", "c_nationkey"], cap=None).select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("orders_cast_by_spec", "S13 P9", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
       CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, CAST(o_custkey AS INTEGER) AS o_custkey
FROM orders
""")
def orders_cast_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"))
    return cast_by_spec(o, {"o_orderkey": "BIGINT", "o_totalprice": "DECIMAL(12,2)", "o_orderdate": "DATE",
                            "o_orderpriority": "NVARCHAR(15)", "o_custkey": "INT"})


@query("customer_string_widths", "S14", """
SELECT * FROM (
  SELECT 'c_name' AS column, CAST(max(length(c_name)) AS INTEGER) AS max_length FROM customer
  UNION ALL SELECT 'c_mktsegment', CAST(max(length(c_mktsegment)) AS INTEGER) FROM customer)
""")
def customer_string_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_widths(table(spark, sf_dir, "customer")).drop("declared_width")


@query("customer_declared_widths", "S14", """
SELECT "column", CAST(least(4000, greatest(coalesce(max_length, 0) * 2, 50)) AS INTEGER) AS declared_width FROM (
  SELECT 'c_name' AS column, max(length(c_name)) AS max_length FROM customer
  UNION ALL SELECT 'c_mktsegment', max(length(c_mktsegment)) FROM customer)
""")
def customer_declared_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_widths(table(spark, sf_dir, "customer")).select("column", F.col("declared_width").cast("int"))


@query("event_type_inference", "S15", """
WITH s AS (SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
                  CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(value AS VARCHAR) AS value,
                  CASE WHEN value > 30 THEN 'true' ELSE 'false' END AS big, '' AS blank FROM events)
SELECT 'event_id' AS column, CASE WHEN NOT coalesce(bool_or(NOT (event_id IS NULL OR trim(event_id) = '')), false) THEN 'string'
  WHEN bool_and(event_id IS NULL OR trim(event_id) = '' OR lower(trim(event_id)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(event_id IS NULL OR trim(event_id) = '' OR (TRY_CAST(trim(event_id) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(event_id), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(event_id IS NULL OR trim(event_id) = '' OR TRY_CAST(trim(event_id) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(event_id IS NULL OR trim(event_id) = '' OR TRY_CAST(trim(event_id) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
UNION ALL
SELECT 'ts' AS column, CASE WHEN NOT coalesce(bool_or(NOT (ts IS NULL OR trim(ts) = '')), false) THEN 'string'
  WHEN bool_and(ts IS NULL OR trim(ts) = '' OR lower(trim(ts)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(ts IS NULL OR trim(ts) = '' OR (TRY_CAST(trim(ts) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(ts), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(ts IS NULL OR trim(ts) = '' OR TRY_CAST(trim(ts) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(ts IS NULL OR trim(ts) = '' OR TRY_CAST(trim(ts) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
UNION ALL
SELECT 'user_id' AS column, CASE WHEN NOT coalesce(bool_or(NOT (user_id IS NULL OR trim(user_id) = '')), false) THEN 'string'
  WHEN bool_and(user_id IS NULL OR trim(user_id) = '' OR lower(trim(user_id)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(user_id IS NULL OR trim(user_id) = '' OR (TRY_CAST(trim(user_id) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(user_id), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(user_id IS NULL OR trim(user_id) = '' OR TRY_CAST(trim(user_id) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(user_id IS NULL OR trim(user_id) = '' OR TRY_CAST(trim(user_id) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
UNION ALL
SELECT 'event_type' AS column, CASE WHEN NOT coalesce(bool_or(NOT (event_type IS NULL OR trim(event_type) = '')), false) THEN 'string'
  WHEN bool_and(event_type IS NULL OR trim(event_type) = '' OR lower(trim(event_type)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(event_type IS NULL OR trim(event_type) = '' OR (TRY_CAST(trim(event_type) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(event_type), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(event_type IS NULL OR trim(event_type) = '' OR TRY_CAST(trim(event_type) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(event_type IS NULL OR trim(event_type) = '' OR TRY_CAST(trim(event_type) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
UNION ALL
SELECT 'value' AS column, CASE WHEN NOT coalesce(bool_or(NOT (value IS NULL OR trim(value) = '')), false) THEN 'string'
  WHEN bool_and(value IS NULL OR trim(value) = '' OR lower(trim(value)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(value IS NULL OR trim(value) = '' OR (TRY_CAST(trim(value) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(value), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(value IS NULL OR trim(value) = '' OR TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(value IS NULL OR trim(value) = '' OR TRY_CAST(trim(value) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
UNION ALL
SELECT 'big' AS column, CASE WHEN NOT coalesce(bool_or(NOT (big IS NULL OR trim(big) = '')), false) THEN 'string'
  WHEN bool_and(big IS NULL OR trim(big) = '' OR lower(trim(big)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(big IS NULL OR trim(big) = '' OR (TRY_CAST(trim(big) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(big), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(big IS NULL OR trim(big) = '' OR TRY_CAST(trim(big) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(big IS NULL OR trim(big) = '' OR TRY_CAST(trim(big) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
UNION ALL
SELECT 'blank' AS column, CASE WHEN NOT coalesce(bool_or(NOT (blank IS NULL OR trim(blank) = '')), false) THEN 'string'
  WHEN bool_and(blank IS NULL OR trim(blank) = '' OR lower(trim(blank)) IN ('true', 'false')) THEN 'bool'
  WHEN bool_and(blank IS NULL OR trim(blank) = '' OR (TRY_CAST(trim(blank) AS BIGINT) IS NOT NULL AND regexp_full_match(trim(blank), '[+-]?[0-9]+'))) THEN 'long'
  WHEN bool_and(blank IS NULL OR trim(blank) = '' OR TRY_CAST(trim(blank) AS DOUBLE) IS NOT NULL) THEN 'real'
  WHEN bool_and(blank IS NULL OR trim(blank) = '' OR TRY_CAST(trim(blank) AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
  ELSE 'string' END AS inferred_type FROM s
""")
def event_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("event_id").cast("string").alias("event_id"),
                 F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                 F.col("user_id").cast("string").alias("user_id"), "event_type",
                 F.col("value").cast("string").alias("value"),
                 F.when(F.col("value") > 30, "true").otherwise("false").alias("big"),
                 F.lit("").alias("blank"))
    return infer_types(s)


@query("layer_audit_counts", "S19", """
SELECT 'lineitem' AS table_name, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM lineitem
UNION ALL SELECT 'orders', count(*), NULL FROM orders
UNION ALL SELECT 'customer', count(*), NULL FROM customer
UNION ALL SELECT 'events', count(*), NULL FROM events
""")
def layer_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_counts(spark, {n: table(spark, sf_dir, n) for n in ["lineitem", "orders", "customer", "events"]})


@query("event_props_parsed", "S21 T2", """
SELECT event_id, event_type,
  TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS BIGINT) AS k_long,
  TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS DOUBLE) AS k_double,
  nullif(trim(json_extract_string(props, '$.k')), '') AS k_text
FROM events
""")
def event_props_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return parse_events(e, "props", ["k"]).drop("props")


@query("orders_projection_pass_through", "P1 P2 P3 S20", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price, o_orderpriority AS priority
FROM orders
""")
def orders_projection_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.operators.quality import drop, project, rename
    from strata.sources import pass_through

    o = pass_through(table(spark, sf_dir, "orders"))  # layer timestamp added ...
    o = drop(o, ["silver_timestamp", "o_orderstatus"])  # ... and dropped (run-dependent)
    o = rename(o, {"o_orderkey": "order_id", "o_custkey": "customer_id"})
    return project(o, {"order_id": "order_id", "customer_id": "customer_id", "o_totalprice": "total_price",
                       "o_orderpriority": "priority"})


ORDERS_CSV_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                     "o_orderdate string, o_orderpriority string")


@query("orders_csv_roundtrip", "S1 S2 S17 S8", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
FROM orders
""")
def orders_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as CSV (a Spark write into the checkpoint folder), then
    ingested with a declared schema, dates parsed after the read, and
    malformed rows dropped."""
    from strata.sources import read_csv
    from strata.streaming import _scratch

    path = _scratch(spark, "landing-orders-csv")
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    o.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path, ORDERS_CSV_SCHEMA, date_cols={"o_orderdate": "yyyy-MM-dd"}, on_bad="drop")


@query("orders_compacted", "S11 S8", "SELECT * FROM orders")
def orders_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction rewrites the table into files of about 512 MB sorted by order
    date; the row set must not change."""
    from strata.sources import compact
    from strata.streaming import _scratch

    return compact(table(spark, sf_dir, "orders"), _scratch(spark, "compact-orders"), sort_cols=["o_orderdate"])
