"""Queries over tables stored in a layout of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.aggregates import kpi
from strata.plans.catalog import query, table
from strata.plans.sales import SQL_ENRICHED, silver_lineitem
from strata.functions import net_units
from strata.session import checkpoint_dir
from strata.sources.buckets import SKEW_BYTES, bucketed_once
from strata.sources.versions import version_of

BUCKET_BYTES = 16 << 20  # a bucket is sorted by one task, where its rows take 10 to 20 times their stored bytes


def bucket_count(spark: SparkSession, paths: list[str], most: int = 1 << 15) -> int:
    """Buckets of about ``BUCKET_BYTES`` of stored files each, a power of two from 8."""
    size = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return min(most, max(8, 1 << (size // BUCKET_BYTES).bit_length()))


def stored_sales(spark: SparkSession, sf_dir: str, skew_bytes: int = SKEW_BYTES) -> tuple[DataFrame, DataFrame]:
    """Silver lines and orders in the same buckets of the order key, written once per version of their files."""
    paths = {n: f"{sf_dir}/{n}.parquet" for n in ("lineitem", "orders")}
    n, base = bucket_count(spark, list(paths.values())), f"{checkpoint_dir(spark).rstrip('/')}/bucketed"
    lines = bucketed_once(spark, "silver_lineitem", version_of(spark, [paths["lineitem"]], "latest, positive"),
                          lambda: silver_lineitem(spark, sf_dir), ["l_orderkey"], n, base, skew_bytes)
    orders = bucketed_once(spark, "silver_orders", version_of(spark, [paths["orders"]]),
                           lambda: table(spark, sf_dir, "orders"), ["o_orderkey"], n, base, skew_bytes)
    return lines, orders


@query("order_margin_bucketed", "S5 J4 W1 A1", SQL_ENRICHED + """
SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS line_count,
       CAST(sum(net_units) AS DOUBLE) / CAST(10000 AS DOUBLE) AS net_revenue, max(ship_date) AS last_ship_date
FROM (SELECT o.o_orderkey, o.o_orderpriority, f.l_orderkey, f.net_units, f.ship_date
      FROM orders o LEFT JOIN f ON f.l_orderkey = o.o_orderkey) GROUP BY ALL
""")
def order_margin_bucketed(spark: SparkSession, sf_dir: str, skew_bytes: int = SKEW_BYTES) -> DataFrame:
    """Every order with its lines' totals: joined and summed where the buckets lie."""
    lines, orders = stored_sales(spark, sf_dir, skew_bytes)
    lines = lines.select("l_orderkey", net_units("l_extendedprice", "l_discount").alias("net_units"),
                         F.to_date("l_shipdate").alias("ship_date"))
    joined = orders.select("o_orderkey", "o_orderpriority").hint("merge").join(
        lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return kpi(joined, ["o_orderkey", "o_orderpriority"], {
        "line_count": F.count("l_orderkey"), "net_revenue": F.sum("net_units") / F.lit(10000.0),
        "last_ship_date": F.max("ship_date")})
