"""Retail sales package: POS lines, products, stores, inventory snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import day_part, net_amount, pct, year_week
from strata.operators.aggregates import dimension, kpi
from strata.operators.joins import enrich, star
from strata.operators.quality import cast_cols, positive, require_not_null
from strata.operators.windows import dense_rank_by
from strata.plans.packages import Package

# Day parts for transaction hours.
DAY_PARTS = [(12, "Morning"), (17, "Afternoon")]
TRIMMED = {"products": ["product_name", "category", "subcategory", "brand"],
           "stores": ["store_name", "city", "state", "region", "store_format"]}


def _trim(df, cols):
    return df.withColumns({c: F.trim(F.col(c)) for c in cols})


def silver(t):
    x = cast_cols(t["pos_transactions"], {"transaction_timestamp": "timestamp", "quantity": "int",
                                          "unit_price": "double", "discount_pct": "double"})
    x = positive(x, ["quantity", "unit_price"])
    x = x.withColumns({
        "line_total": net_amount("quantity", "unit_price", "discount_pct", disc_is_pct=True, digits=2),
        "transaction_date": F.to_date("transaction_timestamp"),
        "transaction_hour": F.hour("transaction_timestamp"),
        "day_of_week": F.dayofweek("transaction_timestamp"),
        "time_of_day": day_part("transaction_timestamp", DAY_PARTS, "Evening")})
    p = require_not_null(_trim(cast_cols(t["products"], {"unit_cost": "double"}), TRIMMED["products"]), ["sku"])
    s = require_not_null(_trim(t["stores"], TRIMMED["stores"]), ["store_id"])
    inv = cast_cols(t["inventory_snapshots"], {"snapshot_date": "date", "quantity_on_hand": "int",
                                               "quantity_on_order": "int", "reorder_point": "int"})
    inv = positive(inv, ["quantity_on_hand"], strict=False)
    inv = inv.withColumn("below_reorder", F.col("quantity_on_hand") < F.col("reorder_point"))
    return {"pos_transactions": x, "products": p, "stores": s, "inventory_snapshots": inv}


def _margins(df, rev, cost, prefix=""):
    return df.withColumns({
        f"{prefix}gross_margin" if not prefix else f"{prefix}margin": F.round(F.col(rev) - F.col(cost), 2),
    }).withColumn(f"{prefix}margin_pct" if prefix else "margin_pct",
                  pct(F.col(rev) - F.col(cost), rev, 2, zero_value=0.0))


def gold(s):
    prod_cols = ["product_name", "category", "subcategory", "brand", "unit_cost"]
    store_cols = ["store_name", "city", "state", "region", "store_format"]
    f = star(s["pos_transactions"], [(s["products"], ("product_id", "sku"), prod_cols),
                                     (s["stores"], "store_id", store_cols)])
    f = f.withColumn("line_cost", F.col("quantity") * F.col("unit_cost"))
    sales = kpi(f, ["transaction_date", "store_id", "store_name", "region", "store_format", "category",
                    "subcategory"], {
        "transaction_count": F.countDistinct("transaction_id"), "line_item_count": F.count(F.lit(1)),
        "total_units_sold": F.sum("quantity"), "total_revenue": F.sum("line_total"),
        "avg_line_total": F.avg("line_total"), "avg_discount_pct": F.avg("discount_pct"),
        "total_cost": F.sum("line_cost")})
    sales = _margins(sales, "total_revenue", "total_cost").withColumns({
        "avg_basket_size": F.round(F.try_divide(F.col("total_revenue"), F.col("transaction_count")), 2),
        "avg_items_per_basket": F.round(F.try_divide(F.col("total_units_sold"), F.col("transaction_count")), 2)})

    inv = enrich(s["inventory_snapshots"], s["products"], ("product_id", "sku"), ["product_name", "category"])
    inv = kpi(inv, ["snapshot_date", "store_id", "category"], {
        "total_on_hand": F.sum("quantity_on_hand"), "total_on_order": F.sum("quantity_on_order"),
        "items_below_reorder": F.sum(F.col("below_reorder").cast("int")), "sku_count": F.count(F.lit(1))})
    inv = inv.withColumn("stockout_risk_pct", pct("items_below_reorder", "sku_count", 2))

    product = kpi(f, ["product_id", "product_name", "category", "subcategory", "brand"], {
        "total_units_sold": F.sum("quantity"), "total_revenue": F.sum("line_total"),
        "total_cost": F.sum("line_cost"), "transaction_count": F.countDistinct("transaction_id"),
        "stores_sold_in": F.countDistinct("store_id"), "avg_discount_pct": F.avg("discount_pct")})
    product = dense_rank_by(_margins(product, "total_revenue", "total_cost"), "total_revenue", name="revenue_rank")

    weekly = kpi(f.withColumn("year_week", year_week("transaction_date")), ["year_week", "region", "category"], {
        "weekly_revenue": F.sum("line_total"), "weekly_units": F.sum("quantity"),
        "weekly_transactions": F.countDistinct("transaction_id"), "avg_discount_pct": F.avg("discount_pct"),
        "weekly_cost": F.sum("line_cost")})
    weekly = _margins(weekly, "weekly_revenue", "weekly_cost", prefix="weekly_")
    return {"gold_sales_daily_summary": sales, "gold_inventory_daily_summary": inv,
            "dim_store": dimension(s["stores"], ["store_id", *store_cols]),
            "dim_product": dimension(s["products"], ["sku", *prod_cols]),
            "gold_product_performance": product, "gold_weekly_trends": weekly}


PACKAGE = Package(
    name="retail",
    sources={
        "stores": "store_id string, store_name string, city string, state string, region string, store_format string",
        "products": "sku string, product_name string, category string, subcategory string, brand string, "
                    "unit_cost string",
        "pos_transactions": "transaction_id string, store_id string, product_id string, "
                            "transaction_timestamp string, quantity string, unit_price string, discount_pct string",
        "inventory_snapshots": "snapshot_date string, store_id string, product_id string, quantity_on_hand string, "
                               "quantity_on_order string, reorder_point string",
    },
    keys={"pos_transactions": ["transaction_id", "product_id"],
          "inventory_snapshots": ["snapshot_date", "store_id", "product_id"]},
    silver=silver, gold=gold, views={},
    stream={"table": "pos_transactions", "signal": "quantity", "group": "store_id", "time": "transaction_timestamp"},
)
