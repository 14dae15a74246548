"""Professional services package: clients, consultants, engagements, timesheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import band, flag, map_category, pct, tenure
from strata.operators.aggregates import kpi, share_of_group, share_of_total, sum_if
from strata.operators.joins import enrich, scorecard
from strata.operators.quality import cast_cols, project
from strata.plans.packages import Package, listing

# Grade bands, NPS bands, margin bands, concentration threshold.
GRADE_BANDS = {"Junior": ["Analyst", "Consultant"], "Mid-Level": ["Senior Consultant", "Manager"]}
NPS_BANDS = [(">=", 50, "Promoter"), (">=", 0, "Passive")]
MARGIN_BANDS = [(">=", 20, "High (≥20%)"), (">=", 5, "Normal (5–20%)"), (">=", 0, "Low (0–5%)")]
CONCENTRATION_PCT = 10
AS_OF: str | None = None  # reference date for tenures; None → current date


def silver(t):
    con = cast_cols(t["consultants"], {"hire_date": "date"})
    con = con.withColumns({"tenure_years": tenure("hire_date", as_of=AS_OF, unit="years"),
                           "grade_band": map_category("grade", GRADE_BANDS, "Senior")})
    # share of the whole portfolio: a scalar subquery, not a driver round trip
    cli = share_of_total(t["clients"], "contract_value_gbp", name="concentration_pct")
    cli = cli.withColumns({"client_concentration_flag": flag(F.col("concentration_pct") > CONCENTRATION_PCT),
                           "nps_band": band("nps_score", NPS_BANDS, "Detractor")})
    eng = cast_cols(t["engagements"], {"start_date": "date", "planned_end_date": "date"})
    eng = eng.withColumns({
        "duration_days": F.datediff("planned_end_date", "start_date"),
        "margin_band": band("margin_pct", MARGIN_BANDS, "Loss-Making (<0%)"),
        "delivery_health_flag": flag(F.col("status").isin("At Risk", "Delayed")),
        "overrun_pct": pct(F.col("actual_spend_gbp") - F.col("budget_gbp"), "budget_gbp", 1)})
    ts = cast_cols(t["timesheets"], {"week_starting": "date"})
    # each row's share of the consultant's week (aggregate + join back)
    ts = share_of_group(ts, ["consultant_id", "week_starting"], "hours_logged", name="_share", digits=1)
    ts = ts.withColumn("billable_utilisation_rate",
                       F.when(F.col("is_billable") == 1, F.col("_share")).otherwise(F.lit(0.0))).drop("_share")
    return {"consultants": con, "clients": cli, "engagements": eng, "timesheets": ts}


def _billable_hours():
    return F.round(sum_if(F.col("is_billable") == 1, "hours_logged", 0.0), 1)


def gold(s):
    con, cli, eng, ts = s["consultants"], s["clients"], s["engagements"], s["timesheets"]
    util = kpi(ts, ["consultant_id"], {
        "total_hours_logged": F.round(F.sum("hours_logged"), 1), "billable_hours": _billable_hours(),
        "total_billed_gbp": F.round(F.sum("billed_value_gbp"), 2),
        "engagements_worked": F.countDistinct("engagement_id")})
    util = util.withColumn("utilisation_rate_pct", pct("billable_hours", "total_hours_logged", 1))
    util = enrich(util, con, "consultant_id", ["grade", "practice", "region", "grade_band", "daily_rate_gbp"])
    prof = project(eng, ["engagement_id", "client_id", "practice", "status", "budget_gbp", "actual_spend_gbp",
                         "margin_pct", "margin_band", "overrun_pct", "delivery_health_flag", "duration_days",
                         "headcount"])
    revenue = scorecard(cli.select("client_id", "client_name", "tier", "industry", "region", "nps_score", "nps_band",
                                   "contract_value_gbp", "concentration_pct"), "client_id", [
        (eng, "client_id", {"total_engagements": F.count("engagement_id"),
                            "total_revenue_gbp": F.round(F.sum("actual_spend_gbp"), 2),
                            "avg_margin_pct": F.round(F.avg("margin_pct"), 2),
                            "at_risk_engagements": F.sum("delivery_health_flag")})])
    health = kpi(eng, ["practice", "status", "margin_band"], {
        "engagements": F.count("engagement_id"), "avg_margin_pct": F.round(F.avg("margin_pct"), 2),
        "avg_overrun_pct": F.round(F.avg("overrun_pct"), 2), "at_risk_count": F.sum("delivery_health_flag")})
    weekly = kpi(ts, ["week_starting"], {
        "total_hours": F.round(F.sum("hours_logged"), 1), "billable_hours": _billable_hours(),
        "total_billed_gbp": F.round(F.sum("billed_value_gbp"), 2),
        "active_consultants": F.countDistinct("consultant_id")})
    weekly = weekly.withColumn("utilisation_rate_pct", pct("billable_hours", "total_hours", 1))
    ts_practice = kpi(enrich(ts, con, "consultant_id", ["practice"]), ["practice"], {
        "total_billed_gbp": F.round(F.sum("billed_value_gbp"), 2), "total_hours": F.round(F.sum("hours_logged"), 1),
        "consultant_count": F.countDistinct("consultant_id")})
    portfolio = scorecard(ts_practice, "practice", [(eng, "practice", {
        "engagements": F.count("engagement_id"), "avg_margin_pct": F.round(F.avg("margin_pct"), 2),
        "at_risk_engagements": F.sum("delivery_health_flag")})])
    return {"gold_consultant_utilisation": util, "gold_project_profitability": prof, "gold_client_revenue": revenue,
            "gold_delivery_health": health, "gold_weekly_trends": weekly, "gold_portfolio_scorecards": portfolio}


VIEWS = {
    "vw_executive_summary": """
        SELECT SUM(engagements) AS total_engagements,
               ROUND(SUM(avg_margin_pct * engagements) / SUM(engagements), 2) AS avg_margin_pct,
               SUM(at_risk_engagements) AS at_risk_engagements, SUM(consultant_count) AS total_consultants,
               ROUND(SUM(total_billed_gbp), 0) AS total_revenue_gbp
        FROM {p}gold_portfolio_scorecards""",
    "vw_low_margin_projects": listing(
        "gold_project_profitability",
        "engagement_id client_id practice status budget_gbp actual_spend_gbp margin_pct "
        "margin_band overrun_pct",
        F.col("margin_pct") < 5),
    "vw_underutilised_consultants": listing(
        "gold_consultant_utilisation",
        "consultant_id grade practice region grade_band utilisation_rate_pct billable_hours "
        "total_billed_gbp",
        F.col("utilisation_rate_pct") < 60),
    "vw_client_revenue_concentration": listing(
        "gold_client_revenue",
        "client_id client_name tier industry total_revenue_gbp concentration_pct avg_margin_pct "
        "nps_score nps_band"),
}

PACKAGE = Package(
    name="professional",
    sources={
        "clients": "client_id string not null, client_name string, industry string, region string, tier string, "
                   "contract_value_gbp double, relationship_years int, nps_score int",
        "consultants": "consultant_id string not null, grade string, practice string, region string, "
                       "daily_rate_gbp int, years_experience int, is_billable int, hire_date string",
        "engagements": "engagement_id string not null, client_id string, lead_consultant_id string, practice string, "
                       "start_date string, planned_end_date string, budget_gbp double, actual_spend_gbp double, "
                       "margin_pct double, status string, headcount int, planned_duration_days int, "
                       "is_over_budget int",
        "timesheets": "timesheet_id string not null, consultant_id string, engagement_id string, week_starting string, "
                      "task_type string, hours_logged double, is_billable int, daily_rate_gbp int, "
                      "billed_value_gbp double",
    },
    keys={"clients": ["client_id"], "consultants": ["consultant_id"], "engagements": ["engagement_id"],
          "timesheets": ["timesheet_id"]},
    silver=silver, gold=gold, views=VIEWS,
    stream={"table": "timesheets", "signal": "hours_logged", "group": "engagement_id", "time": "week_starting"},
)
