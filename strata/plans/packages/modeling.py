"""Per-package model lifecycle (M2–M20) as declarative specs.

Each package names the silver table its model learns from, the label (a
column or an expression), numeric and categorical features with the dimension
columns, fact aggregates and derived columns they come from, the segment for
the risk summary, and whether the task is a regression.  ``run_ml`` builds the feature table (M5), checks the label
(M2), splits by hashing the key (M8), trains a random forest and boosted
trees (M9–M11), evaluates both (M12/M13), picks the champion (M14), and
produces importances (M16), predictions with risk levels (M18/M19) and the
segment summary (M20) — all Spark ML / DataFrame work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import band, pct
from strata.operators import ml
from strata.operators.aggregates import kpi
from strata.operators.contracts import guard_label
from strata.operators.joins import enrich, label_from_events, scorecard, star
from strata.operators.saved import fit_or_load, load_models
from strata.operators.windows import lag_features


@dataclass(frozen=True)
class Dim:
    """Columns of a dimension table joined on ``key`` (``own`` in the fact)."""

    table: str
    key: str
    cols: dict[str, str]  # feature name -> column
    own: str | None = None


@dataclass(frozen=True)
class Fact:
    """Aggregates of another fact table, one row per ``key``."""

    table: str
    key: str
    aggs: dict[str, Column]


@dataclass
class MLSpec:
    """``numeric`` and ``categorical`` are the model's inputs; what happens
    after the moment of prediction is not among them (M5)."""

    table: str
    key: str
    label: str
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    label_expr: Callable[[], Column] | None = None
    segment: Sequence[str] = ()
    regression: bool = False
    dims: Callable[[], Sequence[Dim]] | None = None
    facts: Callable[[], Sequence[Fact]] | None = None
    derived: Callable[[], dict[str, Column]] | None = None
    features: Callable[[dict], DataFrame] | None = None   # custom feature table from silver tables
    summary: Callable[[DataFrame], DataFrame] | None = None  # custom segment summary of the predictions
    bands: Sequence[tuple] | None = None  # of the probability, else the default risk bands
    rf: tuple[int, int] = (120, 10)                       # trees, depth
    min_rows: int = 100


def _same(*cols: str) -> dict[str, str]:
    return {c: c for c in cols}


def _flag(c: str) -> Column:
    return F.col(c).cast("int")


# Event types that count as an outage, nominal grid values.
FAILURES = ("outage", "voltage_sag", "surge", "overload", "equipment_fault")
NOMINAL_VOLTAGE, NOMINAL_FREQUENCY = 230.0, 50.0
SENSORS = ("temperature", "pressure", "vibration", "humidity")
GRID = ("voltage_v", "frequency_hz", "power_factor", "load_mw", "temperature_c")


def _row_key(f: DataFrame, name: str, *cols: str) -> DataFrame:
    return f.withColumn(name, F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def _manufacturing_features(s: dict) -> DataFrame:
    """Machine-day sensor features (M3), labelled by a failure that day (J9);
    downtime, defects and yield of the failing batch stay out."""
    f = ml.entity_day_features(s["sensor_readings"], "machine_id", "reading_timestamp", SENSORS,
                               {"temp_anomaly_count": F.col("temp_anomaly"), "vibration_anomaly_count": F.col("vibration_anomaly")})
    failures = s["production_batches"].filter(_flag("failure_event") == 1).select("machine_id", F.to_date("batch_start").alias("day"))
    f = label_from_events(f, failures, ["machine_id", "day"], "had_failure")
    f = enrich(f, s["equipment_catalog"], "machine_id", ["machine_type", "install_date", "production_line"])
    return _row_key(f.withColumns({
        "anomaly_ratio": (F.col("temp_anomaly_count") + F.col("vibration_anomaly_count")) / F.col("reading_count"),
        "equipment_age_days": F.datediff("day", F.to_date("install_date")), "day_of_week": F.dayofweek("day"),
        "month": F.month("day")}), "machine_day", "machine_id", "day")


def _energy_features(s: dict) -> DataFrame:
    """Substation-day sensor features (M3) labelled by a failure-class event
    that day (J9); a restoration follows a failure and is none."""
    g = s["grid_sensors"]
    f = ml.entity_day_features(g, "substation_id", "timestamp", GRID, {"voltage_anomaly_count": F.col("voltage_anomaly")})
    regions = g.groupBy("substation_id").agg(F.max("region").alias("region"))
    outages = s["power_events"].filter(F.col("event_type").isin(*FAILURES)).select("substation_id", F.to_date("timestamp").alias("day"))
    f = enrich(label_from_events(f, outages, ["substation_id", "day"], "had_outage"), regions, "substation_id")
    return _row_key(f.withColumns({
        "voltage_deviation": F.abs(F.col("avg_voltage_v") - NOMINAL_VOLTAGE),
        "freq_deviation": F.abs(F.col("avg_frequency_hz") - NOMINAL_FREQUENCY),
        "anomaly_ratio": F.col("voltage_anomaly_count") / F.col("reading_count"),
        "day_of_week": F.dayofweek("day"), "month": F.month("day")}), "entity_day", "substation_id", "day")


def _retail_features(s: dict) -> DataFrame:
    """Daily demand per store and product (M6): revenue, discounts, lags,
    product cost and margin, store and product attributes."""
    x = s["pos_transactions"].withColumn("txn_date", F.to_date("transaction_timestamp"))
    d = kpi(x, ["store_id", "product_id", "txn_date"], {
        "daily_quantity": F.sum("quantity"),
        "daily_revenue": F.sum(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct") / 100)),
        "transaction_count": F.count(F.lit(1)), "avg_discount": F.avg("discount_pct"), "avg_price": F.avg("unit_price")})
    d = lag_features(d, ["store_id", "product_id"], "txn_date", {"daily_quantity": [1, 7], "daily_revenue": [1]})
    d = d.withColumnsRenamed({"daily_quantity_lag_1": "demand_lag_1", "daily_quantity_lag_7": "demand_lag_7",
                              "daily_revenue_lag_1": "revenue_lag_1"})
    d = star(d, [(s["products"], ("product_id", "sku"), ["category", "subcategory", "unit_cost"]),
                 (s["stores"], "store_id", ["region", "store_format"])])
    return _row_key(d.withColumns({
        "day_of_week": F.dayofweek("txn_date"), "day_of_month": F.dayofmonth("txn_date"), "month": F.month("txn_date"),
        "week_of_year": F.weekofyear("txn_date"), "is_weekend": F.dayofweek("txn_date").isin(1, 7).cast("int"),
        "margin_pct": pct(F.col("avg_price") - F.col("unit_cost"), "avg_price", None, zero_value=0.0)}),
        "row_key", "store_id", "product_id", "txn_date")


def _demand_trend(p: DataFrame) -> DataFrame:
    """M20, demand: outlook per category and region."""
    g = kpi(p, ["category", "region"], {
        "avg_predicted_demand": F.round(F.avg("predicted"), 1), "avg_actual_demand": F.round(F.avg("daily_quantity"), 1),
        "avg_demand_gap": F.round(F.avg(F.col("predicted") - F.col("daily_quantity")), 1),
        "total_revenue": F.round(F.sum("daily_revenue"), 0), "observations": F.count(F.lit(1)),
        "high_demand_days": F.count_if(F.col("demand_signal") == "high_demand"),
        "low_demand_days": F.count_if(F.col("demand_signal") == "low_demand")})
    return g.withColumn("demand_trend", band("avg_demand_gap", [(">", 2, "growing"), ("<", -2, "declining")], "stable"))


ENGAGEMENT = [(">", 0.8, "very_high"), (">", 0.6, "high"), (">", 0.4, "medium")]


def _engagement(p: DataFrame) -> DataFrame:
    """M20, media: completion per genre."""
    g = kpi(p, ["genre"], {
        "total_views": F.count(F.lit(1)), "predicted_complete_count": F.sum("predicted"),
        "actual_complete_count": F.sum("had_complete"),
        "avg_complete_probability": F.round(F.avg("probability_positive"), 4),
        "avg_duration_mins": F.round(F.avg("duration_mins"), 1)})
    return g.withColumns({"completion_rate": pct("predicted_complete_count", "total_views", 1),
                          "overall_engagement": band("avg_complete_probability", ENGAGEMENT[1:], "low")})


SPECS: dict[str, MLSpec] = {
    "manufacturing": MLSpec(
        "sensor_readings", "machine_day", "had_failure",
        [*(f"{k}_{c}" for c in SENSORS for k in ("avg", "std", "min", "max", "range")), "reading_count", "temp_anomaly_count",
         "vibration_anomaly_count", "anomaly_ratio", "equipment_age_days", "day_of_week", "month"],
        ["machine_type"], None, ["production_line"], features=_manufacturing_features, rf=(60, 8)),
    "financial": MLSpec(
        "transactions", "transaction_id", "had_fraud",
        ["amount", "log_amount", "transaction_hour", "is_night", "is_international", "is_high_value", "balance",
         "credit_limit", "credit_utilisation_pct"],
        ["transaction_type", "merchant_category", "channel", "country", "account_type", "age_group", "segment", "region", "risk_tier"],
        lambda: _flag("is_flagged_fraud"), ["merchant_category"],
        dims=lambda: [Dim("accounts", "account_id", _same("account_type", "balance", "credit_limit", "credit_utilisation_pct")),
                      Dim("customers", "customer_id", _same("age_group", "segment", "region", "risk_tier"))],
        derived=lambda: {"log_amount": F.log1p("amount"), "is_night": _flag("is_night_transaction"),
                         "is_international": _flag("is_international"), "is_high_value": _flag("is_high_value")}, rf=(80, 10)),
    "healthcare": MLSpec(
        "patient_admissions", "admission_id", "had_readmission",
        ["length_of_stay_days", "prior_admissions", "admission_hour", "vital_count", "abnormal_vital_count",
         "avg_vital_value", "abnormal_vital_ratio"],
        ["department", "admission_type", "insurance_type", "age_group", "dx_chapter"],
        lambda: _flag("is_readmission"), ["department"],
        facts=lambda: [Fact("clinical_records", "admission_id", {
            "vital_count": F.count(F.lit(1)), "abnormal_vital_count": F.count_if(_flag("is_abnormal") == 1),
            "avg_vital_value": F.avg("value")})],
        derived=lambda: {"dx_chapter": F.substring("primary_dx_code", 1, 1), "abnormal_vital_ratio": F.col("abnormal_vital_count")
                         / F.greatest("vital_count", F.lit(1))}, rf=(80, 10)),
    "hospitality": MLSpec(
        "bookings", "booking_id", "had_cancel",
        ["nights", "room_rate", "lead_time_days", "is_refundable", "total_stays", "total_spend", "star_rating", "room_count"],
        ["room_type", "channel", "meal_plan", "loyalty_tier", "region", "age_group", "property_type"],
        lambda: F.col("is_cancelled"), ["channel"],
        dims=lambda: [Dim("guests", "guest_id", _same("region", "age_group", "total_stays", "total_spend")),
                      Dim("properties", "property_id", _same("property_type", "star_rating", "room_count"))], rf=(100, 10)),
    "construction": MLSpec(
        "tasks", "task_id", "had_delay",
        ["planned_duration_days", "budget", "sub_rating", "sub_years", "sub_accredited_flag"],
        ["task_name", "project_type", "project_region", "sub_trade"], lambda: F.col("is_delayed"), ["project_id"],
        dims=lambda: [Dim("projects", "project_id", {"project_type": "project_type", "project_region": "region", "budget": "budget"}),
                      Dim("subcontractors", "subcontractor_id", {"sub_trade": "trade", "sub_rating": "rating",
                                                                 "sub_years": "years_active", "sub_accredited": "accredited"})],
        derived=lambda: {"sub_accredited_flag": F.coalesce(F.col("sub_accredited") == "Y", F.lit(False)).cast("int")}),
    "education": MLSpec(
        "enrolments", "enrolment_id", "had_dropout",
        ["credits", "age_at_enrolment", "avg_score", "pass_rate", "assessment_count", "cohort_year"],
        ["department", "level", "programme", "gender", "region"], lambda: F.col("is_withdrawn"), ["department"],
        dims=lambda: [Dim("students", "student_id", _same("programme", "gender", "region", "cohort_year"))],
        facts=lambda: [Fact("assessments", "enrolment_id", {
            "avg_score": F.round(F.avg("score"), 2), "pass_rate": F.round(F.avg(_flag("is_pass")), 4),
            "assessment_count": F.count(F.lit(1))})]),
    "energy": MLSpec(
        "grid_sensors", "entity_day", "had_outage",
        [*(f"{k}_{c}" for c in GRID for k in ("avg", "std", "min", "max", "range")), "reading_count", "voltage_anomaly_count",
         "voltage_deviation", "freq_deviation", "anomaly_ratio", "day_of_week", "month"],
        ["region"], None, ["substation_id"], features=_energy_features, rf=(50, 8)),
    "media": MLSpec(
        "viewing_history", "view_id", "had_complete",
        ["view_hour", "view_dow", "is_weekend", "release_year", "duration_mins", "monthly_fee"],
        ["device_type", "genre", "content_type", "production_cost_bucket", "language", "plan_type", "region", "age_group"],
        lambda: F.col("is_completed"), ["genre"],
        dims=lambda: [Dim("content_catalog", "content_id", _same("genre", "content_type", "release_year", "duration_mins",
                                                                 "production_cost_bucket", "language")),
                      Dim("subscribers", "subscriber_id", _same("plan_type", "region", "age_group", "monthly_fee"))],
        derived=lambda: {"view_dow": F.weekday("view_date"), "is_weekend": (F.weekday("view_date") >= 5).cast("int")},
        summary=_engagement, bands=ENGAGEMENT, rf=(100, 10)),
    "professional": MLSpec(
        "engagements", "engagement_id", "had_overrun",
        ["budget_gbp", "headcount", "planned_duration_days", "contract_value_gbp", "relationship_years", "nps_score",
         "lead_experience", "lead_daily_rate"],
        ["practice", "industry", "tier", "region", "lead_grade"], lambda: F.col("is_over_budget"), ["practice"],
        dims=lambda: [Dim("clients", "client_id", _same("industry", "tier", "region", "contract_value_gbp", "relationship_years", "nps_score")),
                      Dim("consultants", "consultant_id", {"lead_grade": "grade", "lead_experience": "years_experience",
                                                           "lead_daily_rate": "daily_rate_gbp"}, own="lead_consultant_id")]),
    "technology": MLSpec(
        "accounts", "account_id", "had_churn",
        ["mrr_usd", "seat_count", "health_score", "days_as_customer", "user_count", "active_user_count", "avg_logins_30d",
         "event_count", "distinct_features", "avg_duration", "ticket_count", "sla_breach_count", "avg_csat", "avg_resolution_hrs"],
        ["plan", "industry", "region"], lambda: F.col("is_churned"), ["plan"],
        facts=lambda: [
            Fact("users", "account_id", {"user_count": F.count(F.lit(1)), "active_user_count": F.sum(_flag("is_active")),
                                         "avg_logins_30d": F.avg("logins_last_30_days")}),
            Fact("events", "account_id", {"event_count": F.count(F.lit(1)), "distinct_features": F.countDistinct("feature"),
                                          "avg_duration": F.avg("duration_secs")}),
            Fact("support_tickets", "account_id", {"ticket_count": F.count(F.lit(1)), "sla_breach_count": F.sum(_flag("is_sla_breached")),
                                                   "avg_csat": F.avg("csat_score"), "avg_resolution_hrs": F.avg("resolution_hrs")})]),
    "transportation": MLSpec(
        "deliveries", "delivery_id", "had_late",
        ["planned_duration_hrs", "distance_km", "load_tonnes", "capacity_tonnes", "vehicle_age", "sla_hours", "toll_cost_gbp",
         "load_utilisation", "departure_hour", "departure_dow", "is_weekend", "is_rush"],
        ["vehicle_type", "depot", "route_type"], lambda: F.col("is_late"), ["route_id"],
        dims=lambda: [Dim("vehicles", "vehicle_id", {"vehicle_type": "vehicle_type", "depot": "depot", "capacity_tonnes": "capacity_tonnes",
                                                     "vehicle_age": "age_years"}),
                      Dim("routes", "route_id", _same("route_type", "sla_hours", "toll_cost_gbp"))],
        derived=lambda: {
            "load_utilisation": F.when(F.col("capacity_tonnes") > 0, F.col("load_tonnes") / F.col("capacity_tonnes")).otherwise(0.0),
            "departure_hour": F.hour("planned_departure"), "departure_dow": F.dayofweek("planned_departure"),
            "is_weekend": F.dayofweek("planned_departure").isin(1, 7).cast("int"),
            "is_rush": F.hour("planned_departure").isin(7, 8, 9, 16, 17, 18, 19).cast("int")}, rf=(100, 10)),
    "retail": MLSpec(
        "pos_transactions", "row_key", "daily_quantity",
        ["avg_discount", "avg_price", "day_of_week", "day_of_month", "month", "week_of_year", "is_weekend", "demand_lag_1",
         "demand_lag_7", "revenue_lag_1", "unit_cost", "margin_pct"],
        ["category", "subcategory", "region", "store_format"], None, ["category", "region"], regression=True,
        features=_retail_features, summary=_demand_trend, rf=(80, 10)),
}

#: Columns of a feature table that its summary needs and its model does not see.
CARRIED = {"retail": ("daily_revenue",)}


def _joined(spec: MLSpec, silver: dict) -> DataFrame:
    f = silver[spec.table].withColumn(spec.label, spec.label_expr().cast("int"))
    for d in spec.dims() if spec.dims else ():
        dim = silver[d.table].select(d.key, *[F.col(c).alias(n) for n, c in d.cols.items()])
        f = enrich(f.drop(*[n for n in d.cols if n != spec.key]), dim, (d.own or d.key, d.key), list(d.cols))
    if spec.facts:
        key = {x.key for x in spec.facts()}.pop()
        f = scorecard(f, key, [(silver[x.table], x.key, x.aggs) for x in spec.facts()])
        f = f.na.fill(0, [n for x in spec.facts() for n in x.aggs])
    return f.withColumns(spec.derived()) if spec.derived else f


def feature_table(spec: MLSpec, silver: dict) -> DataFrame:
    f = spec.features(silver) if spec.features is not None else _joined(spec, silver)
    carried = next((c for k, c in CARRIED.items() if SPECS.get(k) is spec), ())
    cols = [spec.key, *spec.segment, *spec.numeric, *spec.categorical, *carried, spec.label]
    f = f.select(*dict.fromkeys(cols))
    f = f.withColumns({c: F.col(c).cast("double") for c in spec.numeric} | {c: F.col(c).cast("string") for c in spec.categorical})
    return f.na.fill(0, list(spec.numeric)).na.fill("unknown", list(spec.categorical))


def score_stored(spark, spec: MLSpec, silver: dict, name: str, version: str, base: str | None = None) -> DataFrame:
    """M18 alone: predictions by the stored champion of ``name`` at ``version``; nothing is trained."""
    return _predictions(spec, load_models(spark, name, version, base).model(), feature_table(spec, silver))[0]


def _predictions(spec: MLSpec, model, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of predictions, and all columns for the summary."""
    if spec.regression:
        p = model.transform(f).withColumns({
            "predicted": F.round("prediction", 1),
            "demand_signal": ml.demand_signal("prediction", spec.label)})
        carried = [c for c in f.columns if c not in (spec.key, spec.label, "is_train", *spec.numeric)]
        return p.select(spec.key, spec.label, *carried, "predicted", "demand_signal"), p
    scored = ml.score(model, f, label_name="predicted", prob_name="probability_positive")
    if spec.bands:
        scored = scored.withColumn("risk_level", band("probability_positive", spec.bands, "low"))
    return scored.select(spec.key, *spec.segment, spec.label, "predicted", "probability_positive", "risk_level"), scored


def run_ml(spark, spec: MLSpec, silver: dict, gbt_iter: int = 100, gbt_depth: int = 6, name: str = "package",
           version: str | None = None, base: str | None = None) -> dict[str, DataFrame]:
    """Train, evaluate and score; jobs run while this builds its tables.

    The fitted pipelines are stored as ``name`` at ``version`` (a new one if
    not given) and read from there: a version that is stored is not trained
    again, and ``score_stored`` uses it from any session."""
    version = version or uuid.uuid4().hex
    f = feature_table(spec, silver)
    guard = guard_label(f, spec.label, min_rows=spec.min_rows, regression=spec.regression)
    found = guard.first()
    if not found["passed"]:  # nothing is trained on a label that cannot teach anything
        raise ValueError(f"label guard of {spec.label}: {found.asDict()}")
    f = ml.split_flag(f, spec.key)
    train, test = f.filter("is_train"), f.filter("NOT is_train")
    trees, depth = spec.rf
    fits = {
        "random_forest": lambda: ml.train_rf(train, spec.label, spec.numeric, spec.categorical, trees=trees, max_depth=depth,
                                             regression=spec.regression),
        "gbt": lambda: ml.train_gbt(train, spec.label, spec.numeric, spec.categorical, max_iter=gbt_iter,
                                    max_depth=gbt_depth, regression=spec.regression),
    }
    evaluate = ml.evaluate_regression if spec.regression else ml.evaluate_binary
    saved = fit_or_load(spark, name, version, fits, lambda m, n: evaluate(m.transform(test), spec.label, model_name=n),
                        "rmse" if spec.regression else "auc", not spec.regression, base)
    metrics, model = saved.metrics(), saved.model()
    out = {"gold_ml_features": f, "gold_ml_label_guard": guard, "gold_ml_model_metrics": metrics,
           "gold_ml_feature_importance": ml.importance(spark, model, [*spec.numeric, *spec.categorical])}
    out["gold_ml_predictions"], p = _predictions(spec, model, f)
    if spec.regression:
        if spec.summary:
            out["gold_ml_summary"] = spec.summary(p)
        out["gold_ml_residuals"] = ml.residuals(p, spec.label)
    else:
        out["gold_ml_summary"] = spec.summary(p) if spec.summary else ml.risk_summary(
            p, list(spec.segment), "probability_positive", "predicted", spec.label)
        out["gold_ml_confusion"] = ml.class_report(model.transform(test), spec.label)
    return out
