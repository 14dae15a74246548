"""Energy grid package: grid sensors, power events, renewable generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import deviation
from strata.operators.aggregates import count_if, kpi
from strata.operators.quality import require_not_null
from strata.operators.windows import sigma_flag
from strata.plans.packages import Package

# Nominal voltage and frequency.
NOMINAL_VOLTAGE = 230.0
NOMINAL_FREQUENCY = 50.0


def silver(t):
    s = require_not_null(t["grid_sensors"], ["voltage_v", "frequency_hz"])
    s = s.withColumns({"sensor_date": F.to_date("timestamp"), "sensor_hour": F.hour("timestamp"),
                       "voltage_deviation": deviation("voltage_v", NOMINAL_VOLTAGE),
                       "freq_deviation": deviation("frequency_hz", NOMINAL_FREQUENCY)})
    s = sigma_flag(s, ["substation_id"], "voltage_v", 2.0, "voltage_anomaly")
    e = require_not_null(t["power_events"], ["event_type"])
    e = e.withColumns({"event_date": F.to_date("timestamp"), "event_hour": F.hour("timestamp"),
                       "is_outage": F.coalesce(F.col("event_type") == "outage", F.lit(False)),
                       "resolved": F.lower(F.trim("resolved")) == "true"})
    r = require_not_null(t["renewable_generation"], ["generation_mw"]).withColumn("gen_date", F.to_date("timestamp"))
    return {"grid_sensors": s, "power_events": e, "renewable_generation": r}


def gold(s):
    health = kpi(s["grid_sensors"].withColumnsRenamed({"sensor_date": "date", "sensor_hour": "hour"}),
                 ["date", "hour", "substation_id", "region"], {
        "avg_voltage": F.round(F.avg("voltage_v"), 2), "avg_frequency": F.round(F.avg("frequency_hz"), 3),
        "avg_load": F.round(F.avg("load_mw"), 2), "avg_power_factor": F.round(F.avg("power_factor"), 3),
        "avg_temperature": F.round(F.avg("temperature_c"), 1), "reading_count": F.count(F.lit(1)),
        "voltage_anomalies": count_if(F.col("voltage_anomaly"))})
    et = F.col("event_type")
    outages = kpi(s["power_events"].withColumnRenamed("event_date", "date"), ["date", "region"], {
        "total_events": F.count(F.lit(1)), "outages": count_if(et == "outage"), "surges": count_if(et == "surge"),
        "sags": count_if(et == "voltage_sag"), "faults": count_if(~F.col("resolved")),
        "total_affected": F.sum("affected_customers"),
        "avg_duration_min": F.round(F.avg(F.col("duration_sec") / F.lit(60.0)), 1),
        "critical_events": count_if(F.col("severity") == "critical")})
    renew = kpi(s["renewable_generation"].withColumnRenamed("gen_date", "date"), ["date", "plant_type"], {
        "total_generation_mw": F.round(F.sum("generation_mw"), 2),
        "avg_capacity_factor": F.round(F.avg("capacity_factor"), 3),
        "total_capacity_mw": F.round(F.sum("capacity_mw"), 2), "readings": F.count(F.lit(1))})
    return {"gold_grid_health": health, "gold_outage_summary": outages, "gold_renewable_summary": renew}


VIEWS = {
    "vw_grid_reliability": """
        SELECT region, SUM(total_events) AS events, SUM(outages) AS outages, SUM(total_affected) AS customers_affected,
               ROUND(SUM(total_affected) * AVG(avg_duration_min) / NULLIF(SUM(total_events), 0), 2) AS saidi_index
        FROM {p}gold_outage_summary GROUP BY region""",
}

PACKAGE = Package(
    name="energy",
    sources={
        "grid_sensors": "reading_id string, timestamp timestamp, substation_id string, region string, "
                        "voltage_v double, frequency_hz double, power_factor double, load_mw double, "
                        "temperature_c double",
        "power_events": "event_id string, timestamp timestamp, substation_id string, region string, "
                        "event_type string, severity string, duration_sec int, affected_customers int, "
                        "resolved string",
        "renewable_generation": "reading_id string, timestamp timestamp, plant_id string, plant_type string, "
                                "generation_mw double, capacity_mw double, capacity_factor double, weather string",
    },
    keys={"grid_sensors": ["reading_id"], "power_events": ["event_id"], "renewable_generation": ["reading_id"]},
    silver=silver, gold=gold, views=VIEWS,
    stream={"table": "grid_sensors", "signal": "voltage_v", "group": "substation_id", "time": "timestamp"},
)
