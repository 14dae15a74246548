"""Semantic measure queries (D-series) and data-contract / ontology queries (C-series, M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import units
from strata.operators.contracts import (ColumnRule, Contract, check_key, duplicate_keys, entities,
                                        entity_events, guard_label, violations)
from strata.operators.measures import (auto_measures, average_of_sums, m_avg, m_count, m_count_where,
                                       m_distinct, m_distinct_where, m_divide, m_expr, m_max, m_min, m_sum,
                                       m_sum_where, measures, navigate)
from strata.plans.catalog import query, table


def _lines_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                              "o_orderpriority")
    c = table(spark, sf_dir, "customer")
    f = navigate(li, o, "l_orderkey", "l_orderkey", ["o_custkey", "o_orderpriority"])
    return navigate(f, c, "o_custkey", "c_custkey", ["c_mktsegment"])


@query("segment_measures", "D1 D2 D3 D4 D5 D6 D8 D9 D10", """
WITH f AS (
  SELECT li.*, o.o_custkey, o.o_orderpriority, c.c_mktsegment
  FROM lineitem li LEFT JOIN orders o ON li.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
g AS (
  SELECT c_mktsegment,
    sum(l_quantity) AS total_qty, avg(l_quantity) AS avg_qty,
    min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
    count(*) AS line_count, count(DISTINCT l_orderkey) AS distinct_orders,
    count_if(l_returnflag = 'R') AS returned_lines,
    count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END) AS urgent_levels,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned_qty
  FROM f GROUP BY c_mktsegment)
SELECT *,
  round(coalesce(returned_lines / nullif(line_count, 0), 0.0) * 100, 2) AS return_rate,
  CASE WHEN round(coalesce(returned_lines / nullif(line_count, 0), 0.0) * 100, 2) > 25 OR avg_qty < 25
       THEN 1 ELSE 0 END AS risk_flag,
  round(total_qty * avg_qty / distinct_orders, 4) AS load_index
FROM g
""")
def segment_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _lines_with_segment(spark, sf_dir)
    spec = {
        "total_qty": m_sum("l_quantity"), "avg_qty": m_avg("l_quantity"),
        "min_price": m_min("l_extendedprice"), "max_price": m_max("l_extendedprice"),
        "line_count": m_count(), "distinct_orders": m_distinct("l_orderkey"),
        "returned_lines": m_count_where(F.col("l_returnflag") == "R"),
        "urgent_levels": m_distinct_where("o_orderpriority", ["1-URGENT", "2-HIGH"]),
        "returned_qty": m_sum_where(F.col("l_returnflag") == "R", "l_quantity"),
        "return_rate": m_divide("returned_lines", "line_count", scale=100.0, alternate=0.0, digits=2),
        "risk_flag": m_expr(lambda: F.when((F.col("return_rate") > 25) | (F.col("avg_qty") < 25), 1)
                            .otherwise(0)),
        "load_index": m_expr(lambda: F.round(F.col("total_qty") * F.col("avg_qty") / F.col("distinct_orders"), 4)),
    }
    return measures(f, ["c_mktsegment"], spec)


@query("segment_avg_customer_qty", "D7 A11", """
WITH per AS (
  SELECT c.c_mktsegment, o.o_custkey, sum(li.l_quantity) AS s
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY ALL)
SELECT c_mktsegment, avg(s) AS avg_customer_qty FROM per GROUP BY c_mktsegment
""")
def segment_avg_customer_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _lines_with_segment(spark, sf_dir).filter(F.col("c_mktsegment").isNotNull())
    return average_of_sums(f, ["c_mktsegment"], "o_custkey", "l_quantity", "avg_customer_qty")


@query("lineitem_auto_measures", "D11 A24", """
SELECT count(*) AS row_count, CAST(sum(l_orderkey) AS DECIMAL(38,0)) AS total_l_orderkey,
       CAST(sum(l_partkey) AS DECIMAL(38,0)) AS total_l_partkey, CAST(sum(l_suppkey) AS DECIMAL(38,0)) AS total_l_suppkey
FROM lineitem
""")
def lineitem_auto_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auto_measures(table(spark, sf_dir, "lineitem"))


# ------------------------------------------------------------------ contracts
# The lineitem contract used by the check below.
LINEITEM_CONTRACT = Contract({
    "l_orderkey": ColumnRule(not_null=True),
    "l_quantity": ColumnRule(not_null=True, range=(1, 45)),
    "l_discount": ColumnRule(range=(0.0, 0.08)),
    "l_returnflag": ColumnRule(domain=["R", "A"]),
    "l_linestatus": ColumnRule(domain=["O"]),
    "l_comment": ColumnRule(not_null=True),
})


@query("lineitem_contract_violations", "C1", """
SELECT * FROM (
  SELECT 'l_orderkey' AS column, 'null' AS rule, count_if(l_orderkey IS NULL) AS violations FROM lineitem
  UNION ALL SELECT 'l_quantity', 'null', count_if(l_quantity IS NULL) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'out_of_range', count_if(coalesce(l_quantity < 1 OR l_quantity > 45, false)) FROM lineitem
  UNION ALL SELECT 'l_discount', 'out_of_range', count_if(coalesce(l_discount < 0.0 OR l_discount > 0.08, false)) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'not_in_domain', count_if(l_returnflag IS NOT NULL AND l_returnflag NOT IN ('R', 'A')) FROM lineitem
  UNION ALL SELECT 'l_linestatus', 'not_in_domain', count_if(l_linestatus IS NOT NULL AND l_linestatus NOT IN ('O')) FROM lineitem
  UNION ALL SELECT 'l_comment', 'missing_column', count(*) FROM lineitem)
""")
def lineitem_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(table(spark, sf_dir, "lineitem"), LINEITEM_CONTRACT)


@query("lineitem_key_check", "C4", """
WITH b AS (SELECT l_orderkey, l_linenumber,
                  CAST(l_orderkey IS NULL OR l_linenumber IS NULL AS INTEGER) AS n,
                  coalesce(strlen(CAST(l_orderkey AS VARCHAR)), 0)
                    + coalesce(strlen(CAST(l_linenumber AS VARCHAR)), 0) AS w FROM lineitem)
SELECT count(*) AS row_count, CAST(sum(n) AS BIGINT) AS null_keys,
       CAST(sum(1 - n) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM b WHERE n = 0))
            AS BIGINT) AS duplicate_keys,
       CAST(max(w) AS BIGINT) AS max_key_bytes,
       sum(n) = 0 AND sum(1 - n) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM b WHERE n = 0)) = 0
         AND coalesce(max(w), 0) <= 16 AS key_ok
FROM b
""")
def lineitem_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], max_bytes=16)


@query("lineitem_duplicate_keys", "C4 W9", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def lineitem_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("customer_entities", "C6", """
SELECT c_custkey AS entity_id, arg_max(c_name, (c_name, c_mktsegment, c_nationkey)) AS display_name,
       arg_max(c_mktsegment, (c_name, c_mktsegment, c_nationkey)) AS c_mktsegment,
       arg_max(c_nationkey, (c_name, c_mktsegment, c_nationkey)) AS c_nationkey
FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_custkey
""")
def customer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "customer"), "c_custkey", "c_name", ["c_mktsegment", "c_nationkey"])


@query("order_entity_events", "C7", """
SELECT o_orderkey AS entity_id, o_orderdate AS timestamp_utc, o_totalprice, o_orderstatus
FROM orders WHERE o_orderdate IS NOT NULL
""")
def order_entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_events(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderdate"],
                         ["o_totalprice", "o_orderstatus"])


@query("return_label_guard", "M2", """
SELECT count(*) AS "rows", sum(y) AS positives, round(stddev_samp(y), 6) AS label_stddev,
       count(*) >= 100 AND coalesce(sum(y), 0) >= greatest(10.0, count(*) * 0.01) AS passed
FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM lineitem)
""")
def return_label_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    return guard_label(li, "y").withColumn("label_stddev", F.round("label_stddev", 6))


# ------------------------------------------------------------------ relationship model
def sales_model(spark: SparkSession, sf_dir: str):
    from strata.operators.model import Model, Relation

    names = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")
    return Model({n: table(spark, sf_dir, n) for n in names}, [
        Relation("lineitem", "l_orderkey", "orders", "o_orderkey"), Relation("orders", "o_custkey", "customer", "c_custkey"),
        Relation("customer", "c_nationkey", "nation", "n_nationkey"), Relation("nation", "n_regionkey", "region", "r_regionkey"),
        Relation("lineitem", "l_partkey", "part", "p_partkey"), Relation("lineitem", "l_suppkey", "supplier", "s_suppkey", both=True)])


@query("model_suppliers_of_region", "D10 D1 D2", """
WITH c AS (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
l AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
      AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25))
SELECT s_nationkey, count(*) AS suppliers, CAST(sum(CAST(round(s_acctbal * 100.0) AS BIGINT)) AS BIGINT) AS balance_units
FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l) GROUP BY s_nationkey
""")
def model_suppliers_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on region and part reach the suppliers through the lines, the last step against its relation's direction."""
    from strata.operators.model import Model

    m = sales_model(spark, sf_dir)
    lines = m.filtered("lineitem", {"region": F.col("r_name") == "ASIA", "part": F.col("p_size") > 25})
    near = Model(m.tables | {"lineitem": lines}, m.relations).filtered("supplier", {"lineitem": F.lit(True)})
    return near.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.sum(units("s_acctbal", 2)).alias("balance_units"))


@query("model_lines_by_region", "D10 J4", """
SELECT r_name AS region, n_name AS nation, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def model_lines_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sales_model(spark, sf_dir)
    rows = m.related("lineitem", {"region": "region.r_name", "nation": "nation.n_name"})
    return rows.groupBy("region", "nation").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("model_relation_check", "D10 C4", """
WITH r AS (
  SELECT 'lineitem.l_orderkey -> orders.o_orderkey' AS relation, (SELECT list(o_orderkey) FROM orders) AS k, (SELECT list(DISTINCT l_orderkey) FROM lineitem) AS u
  UNION ALL SELECT 'orders.o_custkey -> customer.c_custkey', (SELECT list(c_custkey) FROM customer), (SELECT list(DISTINCT o_custkey) FROM orders)
  UNION ALL SELECT 'customer.c_nationkey -> nation.n_nationkey', (SELECT list(n_nationkey) FROM nation), (SELECT list(DISTINCT c_nationkey) FROM customer)
  UNION ALL SELECT 'nation.n_regionkey -> region.r_regionkey', (SELECT list(r_regionkey) FROM region), (SELECT list(DISTINCT n_regionkey) FROM nation)
  UNION ALL SELECT 'lineitem.l_partkey -> part.p_partkey', (SELECT list(p_partkey) FROM part), (SELECT list(DISTINCT l_partkey) FROM lineitem)
  UNION ALL SELECT 'lineitem.l_suppkey -> supplier.s_suppkey', (SELECT list(s_suppkey) FROM supplier), (SELECT list(DISTINCT l_suppkey) FROM lineitem)),
k AS (SELECT relation, x, count(*) AS n FROM (SELECT relation, unnest(k) AS x FROM r) GROUP BY 1, 2),
o AS (SELECT relation, count(*) AS orphans FROM (SELECT relation, unnest(u) AS x FROM r) ux ANTI JOIN k USING (relation, x) WHERE x IS NOT NULL GROUP BY 1)
SELECT relation, count_if(x IS NOT NULL AND n > 1)::BIGINT AS repeated_keys, coalesce(sum(n) FILTER (x IS NULL), 0)::BIGINT AS null_keys,
       coalesce(any_value(orphans), 0)::BIGINT AS orphans
FROM k LEFT JOIN o USING (relation) GROUP BY relation
""")
def model_relation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_model(spark, sf_dir).check()
