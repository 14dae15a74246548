"""Hospitality package: properties, guests, bookings, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import amount_if, band, pct, row_mean
from strata.operators.aggregates import kpi
from strata.operators.joins import enrich, scorecard
from strata.operators.quality import cast_cols
from strata.operators.windows import drop_duplicates, rank_by, repeat_flag
from strata.plans.packages import Package, grouped, listing, mean_of_means

# ADR bands, satisfaction bands, property performance bands.
ADR_BANDS = [("<", 100, "Budget"), ("<", 200, "Mid-Scale"), ("<", 400, "Upscale")]
SATISFACTION = [(">=", 9, "Excellent"), (">=", 7, "Good"), (">=", 5, "Fair")]
PERFORMANCE = [(">=", 8.5, "Excellent"), (">=", 7.0, "Good"), (">=", 5.5, "Needs Improvement")]


def silver(t):
    p = drop_duplicates(t["properties"], ["property_id"]).withColumns({
        "property_name": F.trim("property_name"), "city": F.trim("city"), "country": F.upper(F.trim("country"))})
    g = drop_duplicates(t["guests"], ["guest_id"]).withColumns({
        "loyalty_tier": F.trim("loyalty_tier"), "region": F.trim("region")})
    g = cast_cols(g, {"signup_date": ("date", "yyyy-MM-dd")})
    b = cast_cols(drop_duplicates(t["bookings"], ["booking_id"]),
                  {"check_in_date": ("date", "yyyy-MM-dd"), "check_out_date": ("date", "yyyy-MM-dd")})
    done = F.col("status") == "completed"
    b = b.withColumns({
        "length_of_stay": F.datediff("check_out_date", "check_in_date"),
        "adr_band": band("room_rate", ADR_BANDS, "Luxury"),
        "is_completed": done.cast("int"), "is_cancelled": (F.col("status") == "cancelled").cast("int"),
        "revenue": amount_if(done, "total_amount", 0.0)})
    r = cast_cols(drop_duplicates(t["reviews"], ["review_id"]), {"review_date": ("date", "yyyy-MM-dd")})
    r = r.withColumns({
        "composite_score": row_mean(["cleanliness_score", "service_score", "value_score", "food_score"], 2),
        "satisfaction_band": band("overall_score", SATISFACTION, "Poor")})
    return {"properties": p, "guests": g, "bookings": b, "reviews": r}


def gold(s):
    # repeat guest = a guest with more than one booking (count per key joined back)
    b = repeat_flag(s["bookings"], "guest_id", "is_repeat_guest")
    done = b.filter(F.col("is_completed") == 1)
    p = s["properties"]
    daily = kpi(enrich(done, p, "property_id", ["city", "country", "star_rating", "room_count"]),
                ["property_id", "city", "country", "star_rating", "room_count", "check_in_date"], {
        "bookings": F.count("booking_id"), "total_revenue": F.sum("revenue"),
        "adr": F.round(F.avg("room_rate"), 2), "avg_los": F.round(F.avg("length_of_stay"), 2)})
    daily = daily.withColumns({"revpar": pct("total_revenue", "room_count", 2, scale=1.0),
                               "occupancy_rate": pct("bookings", "room_count", 2)})
    occ = kpi(enrich(b, p, "property_id", ["city", "star_rating", "room_count"]),
              ["property_id", "city", "star_rating", "room_type", "adr_band"], {
        "total_bookings": F.count("booking_id"), "completed_bookings": F.sum("is_completed"),
        "cancelled_bookings": F.sum("is_cancelled"), "total_revenue": F.round(F.sum("revenue"), 2),
        "avg_rate": F.round(F.avg("room_rate"), 2), "avg_los": F.round(F.avg("length_of_stay"), 2)})
    occ = occ.withColumn("cancellation_rate", pct("cancelled_bookings", "total_bookings", 2))
    guest_cols = ["loyalty_tier", "region", "age_group"]
    lj = enrich(done.drop("loyalty_tier"), s["guests"], "guest_id", guest_cols)
    loyalty = kpi(lj, guest_cols, {
        "total_bookings": F.count("booking_id"), "unique_guests": F.countDistinct("guest_id"),
        "total_revenue": F.round(F.sum("revenue"), 2), "avg_rate": F.round(F.avg("room_rate"), 2),
        "avg_los": F.round(F.avg("length_of_stay"), 2),
        "repeat_guest_pct": F.round(F.avg("is_repeat_guest") * F.lit(100.0), 1)})
    loyalty = loyalty.withColumn("revenue_per_guest", pct("total_revenue", "unique_guests", 2, scale=1.0))
    # distinct guests per (tier, region) from base rows — summing per-age-group counts would double count
    loyalty_guests = kpi(lj, ["loyalty_tier", "region"], {"unique_guests": F.countDistinct("guest_id")})
    channel = kpi(b, ["channel"], {
        "total_bookings": F.count("booking_id"), "completed": F.sum("is_completed"), "cancelled": F.sum("is_cancelled"),
        "total_revenue": F.round(F.sum("revenue"), 2), "avg_rate": F.round(F.avg("room_rate"), 2),
        "avg_los": F.round(F.avg("length_of_stay"), 2)})
    channel = channel.withColumn("conversion_rate", pct("completed", "total_bookings", 2))
    weekly = kpi(done.withColumn("week", F.to_date(F.date_trunc("week", "check_in_date"))), ["week"], {
        "bookings": F.count("booking_id"), "total_revenue": F.round(F.sum("revenue"), 2),
        "adr": F.round(F.avg("room_rate"), 2), "avg_los": F.round(F.avg("length_of_stay"), 2)})
    card = scorecard(
        p.select("property_id", "property_name", "city", "country", "star_rating", "room_count", "property_type"),
        "property_id", [
            (done, "property_id", {"total_bookings": F.count("booking_id"),
                                   "total_revenue": F.round(F.sum("revenue"), 2),
                                   "adr": F.round(F.avg("room_rate"), 2), "avg_los": F.round(F.avg("length_of_stay"), 2),
                                   "repeat_guest_pct": F.round(F.avg("is_repeat_guest") * F.lit(100.0), 1)}),
            (s["reviews"], "property_id", {"review_count": F.count("review_id"),
                                           "avg_overall_score": F.round(F.avg("overall_score"), 2),
                                           "avg_cleanliness": F.round(F.avg("cleanliness_score"), 2),
                                           "avg_service": F.round(F.avg("service_score"), 2),
                                           "avg_value": F.round(F.avg("value_score"), 2),
                                           "avg_food": F.round(F.avg("food_score"), 2)})])
    card = card.withColumns({"revpar": pct("total_revenue", "room_count", 2, scale=1.0),
                             "performance_band": band("avg_overall_score", PERFORMANCE, "Critical")})
    card = rank_by(rank_by(card, "revpar", name="revpar_rank"), "avg_overall_score", name="satisfaction_rank")
    return {"gold_daily_revenue": daily, "gold_occupancy_analysis": occ, "gold_loyalty_segments": loyalty,
            "gold_loyalty_guests": loyalty_guests, "gold_channel_performance": channel, "gold_weekly_trends": weekly,
            "gold_property_scorecards": card}


VIEWS = {
    "vw_executive_summary": listing(
        "gold_property_scorecards",
        "property_id property_name city country star_rating property_type total_bookings "
        "total_revenue adr avg_los revpar repeat_guest_pct review_count avg_overall_score "
        "performance_band revpar_rank satisfaction_rank"),
    "vw_revenue_heatmap": grouped(
        "gold_daily_revenue", "stay_date=check_in_date city country star_rating", "total_bookings=bookings total_revenue",
        avg_adr=mean_of_means("adr", "bookings"),
        avg_revpar=pct(F.sum("total_revenue"), F.sum("room_count"), scale=1.0),
        avg_occupancy_rate=pct(F.sum("bookings"), F.sum("room_count"))),
    "vw_loyalty_analysis": """
        SELECT l.loyalty_tier, l.region, SUM(l.total_bookings) AS total_bookings, MAX(g.unique_guests) AS unique_guests,
               ROUND(SUM(l.total_revenue), 2) AS total_revenue,
               ROUND(SUM(l.avg_rate * l.total_bookings) / SUM(l.total_bookings), 2) AS avg_rate,
               ROUND(SUM(l.avg_los * l.total_bookings) / SUM(l.total_bookings), 2) AS avg_los,
               ROUND(SUM(l.repeat_guest_pct * l.total_bookings) / SUM(l.total_bookings), 1) AS repeat_guest_pct,
               ROUND(SUM(l.total_revenue) / NULLIF(MAX(g.unique_guests), 0), 2) AS revenue_per_guest
        FROM {p}gold_loyalty_segments l
        LEFT JOIN {p}gold_loyalty_guests g
          ON l.loyalty_tier <=> g.loyalty_tier AND l.region <=> g.region
        GROUP BY l.loyalty_tier, l.region""",
    "vw_property_performance": listing(
        "gold_property_scorecards",
        "property_id property_name city country star_rating property_type room_count total_bookings "
        "total_revenue adr revpar avg_los repeat_guest_pct review_count avg_overall_score avg_cleanliness "
        "avg_service avg_value avg_food performance_band",
        total_revenue=F.round("total_revenue", 2)),
}

PACKAGE = Package(
    name="hospitality",
    sources={
        "properties": "property_id string, property_name string, city string, country string, property_type string, "
                      "star_rating int, room_count int",
        "guests": "guest_id string, loyalty_tier string, region string, age_group string, nationality string, "
                  "total_stays int, total_spend double, preferred_channel string, signup_date string",
        "bookings": "booking_id string, property_id string, guest_id string, check_in_date string, "
                    "check_out_date string, nights int, room_type string, channel string, meal_plan string, "
                    "room_rate double, total_amount double, status string, lead_time_days int, "
                    "is_refundable int, is_cancelled_src int, loyalty_tier string",
        "reviews": "review_id string, booking_id string, property_id string, guest_id string, review_date string, "
                   "overall_score double, cleanliness_score double, service_score double, value_score double, "
                   "food_score double, sentiment string, platform string",
    },
    keys={"properties": ["property_id"], "guests": ["guest_id"], "bookings": ["booking_id"], "reviews": ["review_id"]},
    silver=silver, gold=gold, views=VIEWS,
    stream={"table": "bookings", "signal": "room_rate", "group": "property_id", "time": "check_in_date"},
)
