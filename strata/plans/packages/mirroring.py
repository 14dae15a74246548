"""Mirroring path of each package: spec-typed keyed load, headline query and
one propagated source change.

A mirror is the package's landing tables loaded the way a replicated copy of
an operational database looks: columns typed by the spec's SQL types (S13),
one row per primary key (S12, optional row cap, off by default), exposed as
``m_<table>`` views (S9).  The headline is a grouped KPI block over those
tables (A1/A5/J1 compositions, ordered for reporting, O1).  ``live_change``
re-expresses the replication demo as a Spark job: pick the first row by key
that the change would alter (O5), derive the new value from it, apply it as a
keyed change (T10) and report the difference against the old copy (T11) — no
row goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.aggregates import count_if, kpi
from strata.operators.joins import enrich
from strata.operators.ordering import first_match
from strata.plans.packages import Package, Tables
from strata.sources import capped_load, cast_by_spec, read_csv
from strata.streaming import apply_changes, current_rows, replica_diff


@dataclass(frozen=True)
class Change:
    table: str
    key: str
    column: str
    kind: str                 # 'flag' (set to ``to``) or 'number' (× factor + 1, 2 decimals)
    to: int = 1
    factor: float = 1.15


@dataclass(frozen=True)
class Mirror:
    keys: Mapping[str, list[str]]                     # table → primary key
    types: Mapping[str, Mapping[str, str]]            # table → {column: SQL type}
    headline: Callable[[Tables], DataFrame]
    change: Change
    renames: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def _avg1(c: str, digits: int) -> F.Column:
    return F.round(F.avg(F.col(c).cast("double")), digits)


def _share(part: F.Column, whole: F.Column, digits: int) -> F.Column:
    return F.round(F.try_divide(part * F.lit(100.0), F.nullif(whole, F.lit(0))), digits)


def _desc(df: DataFrame, c: str) -> DataFrame:
    return df.orderBy(F.col(c).desc_nulls_last())


# ------------------------------------------------------------------ headlines
def _manufacturing(t: Tables) -> DataFrame:
    g = kpi(t["production_batches"], ["production_line"], {
        "batches": F.count(F.lit(1)), "units": F.sum("units_produced"), "defects": F.sum("defect_count"),
        "defect_rate_pct": _share(F.sum("defect_count"), F.sum("units_produced"), 2),
        "downtime_min": F.sum("downtime_minutes")})
    return _desc(g, "defect_rate_pct")


def _retail(t: Tables) -> DataFrame:
    f = enrich(t["pos_transactions"], t["products"], ("product_id", "sku"), ["category"], how="inner")
    f = enrich(f, t["stores"], "store_id", ["region"], how="inner")
    line = F.col("quantity") * F.col("unit_price") * (F.lit(1) - F.col("discount_pct") / F.lit(100))
    return _desc(kpi(f, ["category", "region"], {"transactions": F.count(F.lit(1)),
                                                 "revenue": F.round(F.sum(line), 0)}), "revenue")


def _energy(t: Tables) -> DataFrame:
    return _desc(kpi(t["power_events"], ["region", "severity"], {
        "events": F.count(F.lit(1)), "customers_affected": F.sum("affected_customers"),
        "resolved_events": count_if(F.col("resolved"))}), "customers_affected")


def _financial(t: Tables) -> DataFrame:
    return _desc(kpi(t["transactions"], ["merchant_category"], {
        "transactions": F.count(F.lit(1)), "total_amount": F.round(F.sum("amount"), 0),
        "flagged_fraud": count_if(F.col("is_flagged_fraud"))}), "total_amount")


def _healthcare(t: Tables) -> DataFrame:
    return _desc(kpi(t["patient_admissions"], ["department"], {
        "admissions": F.count(F.lit(1)), "avg_los_days": _avg1("length_of_stay_days", 1),
        "readmissions": count_if(F.col("is_readmission"))}), "admissions")


def _hospitality(t: Tables) -> DataFrame:
    f = enrich(t["bookings"], t["properties"], "property_id", ["property_name", "city"], how="inner")
    return _desc(kpi(f, ["property_name", "city"], {
        "bookings": F.count(F.lit(1)), "room_nights": F.sum("nights"),
        "revenue": F.round(F.sum("total_amount"), 0), "cancellations": count_if(F.col("is_cancelled"))}),
        "revenue")


def _construction(t: Tables) -> DataFrame:
    f = enrich(t["tasks"], t["projects"], "project_id", ["project_type"], how="inner")
    return _desc(kpi(f, ["project_type"], {
        "projects": F.countDistinct("project_id"), "tasks": F.count(F.lit(1)),
        "delayed_tasks": count_if(F.col("is_delayed")),
        "avg_schedule_var_days": _avg1("schedule_variance_days", 1)}), "delayed_tasks")


def _education(t: Tables) -> DataFrame:
    return _desc(kpi(t["enrolments"], ["department"], {
        "enrolments": F.count(F.lit(1)), "completed": count_if(F.col("is_completed")),
        "withdrawn": count_if(F.col("is_withdrawn")),
        "withdrawal_rate_pct": _share(count_if(F.col("is_withdrawn")), F.count(F.lit(1)), 2)}),
        "withdrawal_rate_pct")


def _media(t: Tables) -> DataFrame:
    f = enrich(t["viewing_history"], t["content_catalog"], "content_id", ["genre"], how="inner")
    return _desc(kpi(f, ["genre"], {
        "views": F.count(F.lit(1)), "watch_minutes": F.sum("watch_duration_mins"),
        "completion_rate_pct": _share(count_if(F.col("is_completed")), F.count(F.lit(1)), 1)}),
        "watch_minutes")


def _technology(t: Tables) -> DataFrame:
    return _desc(kpi(t["support_tickets"], ["priority"], {
        "tickets": F.count(F.lit(1)), "avg_resolution_hrs": F.round(F.avg("resolution_hrs"), 1),
        "sla_breaches": count_if(F.col("is_sla_breached")), "avg_csat": _avg1("csat_score", 2)}),
        "sla_breaches")


def _professional(t: Tables) -> DataFrame:
    return _desc(kpi(t["engagements"], ["practice"], {
        "engagements": F.count(F.lit(1)), "avg_margin_pct": F.round(F.avg("margin_pct"), 1),
        "over_budget": count_if(F.col("is_over_budget")),
        "total_spend": F.round(F.sum("actual_spend_gbp"), 0)}), "avg_margin_pct")


def _transportation(t: Tables) -> DataFrame:
    f = enrich(t["deliveries"], t["routes"], "route_id", ["origin", "destination"], how="inner")
    return _desc(kpi(f, ["origin", "destination"], {
        "deliveries": F.count(F.lit(1)), "late_deliveries": count_if(F.col("is_late")),
        "avg_delay_hrs": F.round(F.avg("delay_hrs"), 2)}), "late_deliveries")


# ------------------------------------------------------------------ specs
# Each package's mirrored tables with their primary keys, the
# SQL types of the columns its headline and change read, and the change
# (table, key, column, kind, new flag value or factor), as the package specs
# state them.
MIRRORS: dict[str, Mirror] = {
    "manufacturing": Mirror(
        keys={"equipment_catalog": ["machine_id"], "production_batches": ["batch_id"],
              "sensor_readings": ["reading_id"]},
        types={"production_batches": {"units_produced": "INT", "defect_count": "INT",
                                      "downtime_minutes": "INT", "failure_event": "BIT"}},
        headline=_manufacturing,
        change=Change("production_batches", "batch_id", "failure_event", "flag", to=1)),
    "retail": Mirror(
        keys={"products": ["sku"], "stores": ["store_id"], "pos_transactions": ["transaction_id"],
              "inventory_snapshots": ["snapshot_date", "store_id", "product_id"]},
        types={"products": {"unit_cost": "DECIMAL(10,2)"},
               "pos_transactions": {"quantity": "INT", "unit_price": "DECIMAL(10,2)",
                                    "discount_pct": "DECIMAL(5,2)"}},
        headline=_retail,
        change=Change("products", "sku", "unit_cost", "number", factor=1.15)),
    "energy": Mirror(
        keys={"grid_sensors": ["reading_id"], "power_events": ["event_id"],
              "renewable_generation": ["reading_id"]},
        types={"power_events": {"affected_customers": "INT", "resolved": "BIT"}},
        headline=_energy,
        change=Change("power_events", "event_id", "resolved", "flag", to=1)),
    "financial": Mirror(
        keys={"customers": ["customer_id"], "accounts": ["account_id"], "transactions": ["transaction_id"]},
        types={"transactions": {"amount": "DECIMAL(14,2)", "is_flagged_fraud": "BIT"}},
        headline=_financial,
        change=Change("transactions", "transaction_id", "is_flagged_fraud", "flag", to=1)),
    "healthcare": Mirror(
        keys={"staff_catalog": ["staff_id"], "patient_admissions": ["admission_id"],
              "clinical_records": ["record_id"]},
        types={"patient_admissions": {"length_of_stay_days": "INT", "is_readmission": "BIT"},
               "clinical_records": {"value": "DECIMAL(10,2)"}},
        headline=_healthcare,
        change=Change("clinical_records", "record_id", "value", "number", factor=1.2)),
    "hospitality": Mirror(
        keys={"properties": ["property_id"], "guests": ["guest_id"], "bookings": ["booking_id"],
              "reviews": ["review_id"]},
        types={"bookings": {"nights": "INT", "total_amount": "DECIMAL(14,2)", "is_cancelled": "BIT"}},
        headline=_hospitality,
        change=Change("bookings", "booking_id", "is_cancelled", "flag", to=1),
        renames={"bookings": {"is_cancelled_src": "is_cancelled"}}),
    "construction": Mirror(
        keys={"subcontractors": ["subcontractor_id"], "projects": ["project_id"], "tasks": ["task_id"],
              "cost_ledger": ["cost_id"]},
        types={"tasks": {"schedule_variance_days": "INT", "is_delayed": "BIT"}},
        headline=_construction,
        change=Change("tasks", "task_id", "is_delayed", "flag", to=1),
        renames={"tasks": {"is_delayed_src": "is_delayed"}}),
    "education": Mirror(
        keys={"faculty": ["faculty_id"], "students": ["student_id"], "enrolments": ["enrolment_id"],
              "assessments": ["assessment_id"]},
        types={"enrolments": {"is_completed": "BIT", "is_withdrawn": "BIT"}},
        headline=_education,
        change=Change("enrolments", "enrolment_id", "is_withdrawn", "flag", to=1)),
    "media": Mirror(
        keys={"content_catalog": ["content_id"], "subscribers": ["subscriber_id"],
              "viewing_history": ["view_id"], "ad_impressions": ["impression_id"]},
        types={"viewing_history": {"watch_duration_mins": "INT", "is_completed": "BIT"},
               "subscribers": {"is_churned": "BIT"}},
        headline=_media,
        change=Change("subscribers", "subscriber_id", "is_churned", "flag", to=1)),
    "technology": Mirror(
        keys={"accounts": ["account_id"], "users": ["user_id"], "events": ["event_id"],
              "support_tickets": ["ticket_id"]},
        types={"support_tickets": {"resolution_hrs": "DECIMAL(8,2)", "is_sla_breached": "BIT",
                                   "csat_score": "INT"},
               "accounts": {"is_churned": "BIT"}},
        headline=_technology,
        change=Change("accounts", "account_id", "is_churned", "flag", to=1)),
    "professional": Mirror(
        keys={"clients": ["client_id"], "consultants": ["consultant_id"], "engagements": ["engagement_id"],
              "timesheets": ["timesheet_id"]},
        types={"engagements": {"margin_pct": "DECIMAL(8,2)", "actual_spend_gbp": "DECIMAL(16,2)",
                               "is_over_budget": "BIT"}},
        headline=_professional,
        change=Change("engagements", "engagement_id", "is_over_budget", "flag", to=1)),
    "transportation": Mirror(
        keys={"vehicles": ["vehicle_id"], "routes": ["route_id"], "deliveries": ["delivery_id"],
              "fuel_logs": ["log_id"]},
        types={"deliveries": {"delay_hrs": "DECIMAL(8,2)", "is_late": "BIT"}},
        headline=_transportation,
        change=Change("deliveries", "delivery_id", "is_late", "flag", to=1)),
}


# ------------------------------------------------------------------ runners
def load_mirror(spark: SparkSession, pkg: Package, landing: str, cap: int | None = None,
                prefix: str = "m_") -> Tables:
    """Typed, keyed load of every landing table the mirror declares; each is
    also registered as a ``{prefix}{table}`` view for spec SQL (S9)."""
    m = MIRRORS[pkg.name]
    out = {}
    for t, pk in m.keys.items():
        if t not in pkg.sources:
            continue
        df = read_csv(spark, f"{landing}/{t}.csv", pkg.sources[t], date_cols=pkg.date_cols.get(t))
        df = df.withColumnsRenamed(dict(m.renames.get(t, {})))
        df = cast_by_spec(df, m.types.get(t, {}))
        out[t] = capped_load(df, pk, cap)
        out[t].createOrReplaceTempView(f"{prefix}{t}")
    return out


def headline(pkg: Package, tables: Tables) -> DataFrame:
    return MIRRORS[pkg.name].headline(tables)


def live_change(pkg: Package, tables: Tables) -> tuple[Tables, DataFrame]:
    """Apply the package's source change to its mirror.

    Returns the tables with the changed one replaced, and the replica
    difference between the old and new copy (one row when a row qualified).
    """
    c = MIRRORS[pkg.name].change
    base = tables[c.table]
    col = F.col(c.column)
    if c.kind == "flag":
        to = F.lit(c.to).cast(base.schema[c.column].dataType)
        target = first_match(base, col.isNull() | (col != to), c.key)
        new = to
    elif c.kind == "number":
        target = first_match(base, col.isNotNull(), c.key)
        new = F.round(col.cast("double") * F.lit(c.factor) + F.lit(1.0), 2).cast(base.schema[c.column].dataType)
    else:
        raise ValueError(c.kind)
    changes = target.select(c.key, new.alias(c.column), F.lit(1).alias("__seq"), F.lit("U").alias("op"))
    after = current_rows(apply_changes(base, changes, [c.key], "__seq"))
    return {**tables, c.table: after}, replica_diff(base, after, [c.key])
