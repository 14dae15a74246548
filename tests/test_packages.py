"""Industry packages on tiny hand-written landing files (FIXTURES schemas)."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from strata.plans.packages import PACKAGES, get, run_package


def _land(files: dict[str, str]) -> str:
    d = tempfile.mkdtemp(prefix="strata-landing-")
    for name, text in files.items():
        with open(os.path.join(d, f"{name}.csv"), "w") as fh:
            fh.write(text.strip() + "\n")
    return d


MANUFACTURING = {
    "equipment_catalog": """
machine_id,machine_name,machine_type,production_line,install_date
m1,Press 1,press,L1,2020-01-01
m2,Lathe 2,lathe,L2,2021-06-01
""",
    "sensor_readings": """
reading_id,machine_id,production_line,reading_timestamp,temperature,pressure,vibration,humidity
r1,m1,L1,2024-12-30 07:00:00,70.0,100,1.0,40
r1,m1,L1,2024-12-30 07:00:00,70.0,100,1.0,40
r2,m1,L1,2024-12-30 09:00:00,71.0,101,1.1,41
r3,m1,L1,2024-12-30 17:00:00,69.0,99,0.9,42
r4,m1,L1,2024-12-30 18:00:00,150.0,100,5.0,40
r5,m2,L2,2024-12-31 10:00:00,60.0,90,0.5,30
r6,m2,L2,bad,60.0,90,0.5,30
r7,m2,L2,2024-12-31 11:00:00,600.0,90,0.5,30
""",
    "production_batches": """
batch_id,production_line,product,batch_start,batch_end,planned_units,units_produced,defect_count,downtime_minutes,machine_id,failure_event
b1,L1,widget,2024-12-30 07:00:00,2024-12-30 15:00:00,110,100,5,30,m1,0
b1,L1,widget,2024-12-30 07:00:00,2024-12-30 15:00:00,110,100,5,30,m1,0
b2,L1,gadget,2024-12-30 09:00:00,2024-12-30 17:00:00,50,0,0,480,m1,1
b3,L2,widget,2025-01-06 16:30:00,2025-01-07 00:30:00,200,190,10,0,m2,0
""",
}


def test_manufacturing_package(spark):
    from strata.plans.packages import stream_queries

    out = run_package(spark, get("manufacturing"), _land(MANUFACTURING))
    rt = stream_queries(get("manufacturing"), out["silver"]["sensor_readings"])
    assert rt["row_count"].collect()[0].row_count == 5
    assert rt["signal_by_group"].collect()[0].machine_id == "m1"
    assert rt["records_per_minute"].count() == 5
    silver, gold = out["silver"], out["gold"]
    s = {r.reading_id: r for r in silver["sensor_readings"].collect()}
    assert sorted(s) == ["r1", "r2", "r3", "r4", "r5"]          # dedupe, bad time, out of range
    assert s["r5"].temp_anomaly is False                         # single reading → False, not NULL
    assert s["r1"].shift == "Night" and s["r2"].shift == "Day" and s["r3"].shift == "Evening"
    daily = {(r.product, r.shift): r for r in gold["gold_production_daily_summary"].collect()}
    b1 = daily[("widget", "Night")]
    assert (b1.availability, b1.performance, b1.quality, b1.oee) == (0.9375, 0.9091, 0.95, 80.97)
    assert b1.oee_class == "Acceptable" and (b1.production_year, b1.production_week) == (2025, 1)
    b2 = daily[("gadget", "Day")]
    assert b2.avg_yield_pct == 0.0 and b2.quality is None and b2.oee_class == "Critical"
    ranks = {r.product: r.quality_rank for r in gold["gold_product_quality"].collect()}
    assert ranks["widget"] == 1 and ranks["gadget"] == 2
    trends = {(r.production_line, r.production_week): r.trend_direction for r in gold["gold_weekly_trends"].collect()}
    assert trends[("L1", 1)] is None                            # first period: no label
    views = out["views"]
    assert views["vw_executive_dashboard"].count() == 3
    worst = {r.shift: r.oee_classification for r in views["vw_executive_dashboard"].collect()
             if r.production_line == "L1"}
    assert worst["Day"] == "Critical"
    assert views["vw_quality_scorecard"].count() == 2


RETAIL = {
    "stores": """
store_id,store_name,city,state,region,store_format
s1, Main St ,Leeds,WY,North,Mall
s2,High St,Bath,SO,South,Street
""",
    "products": """
sku,product_name,category,subcategory,brand,unit_cost
p1,Tea,Grocery,Drinks,Acme,2.00
p2,Mug,Home,Kitchen,Acme,3.00
""",
    "pos_transactions": """
transaction_id,store_id,product_id,transaction_timestamp,quantity,unit_price,discount_pct
t1,s1,p1,2024-12-30 09:00:00,2,5.00,10
t1,s1,p1,2024-12-30 09:00:00,2,5.00,10
t1,s1,p2,2024-12-30 09:00:00,1,10.00,0
t2,s2,p1,2024-12-31 18:00:00,3,5.00,0
t3,s2,p9,2024-12-31 13:00:00,1,4.00,0
t4,s2,p1,2024-12-31 13:00:00,0,4.00,0
""",
    "inventory_snapshots": """
snapshot_date,store_id,product_id,quantity_on_hand,quantity_on_order,reorder_point
2024-12-30,s1,p1,5,10,8
2024-12-30,s1,p2,20,0,8
""",
}


def test_retail_package(spark):
    out = run_package(spark, get("retail"), _land(RETAIL))
    x = {(r.transaction_id, r.product_id): r for r in out["silver"]["pos_transactions"].collect()}
    assert len(x) == 4 and ("t4", "p1") not in x                  # dedupe + positive quantity
    assert x[("t1", "p1")].line_total == 9.0 and x[("t1", "p1")].time_of_day == "Morning"
    assert x[("t2", "p1")].time_of_day == "Evening" and x[("t3", "p9")].time_of_day == "Afternoon"
    stores = {r.store_id: r.store_name for r in out["silver"]["stores"].collect()}
    assert stores["s1"] == "Main St"                                # trimmed
    g = out["gold"]
    sales = {(r.store_id, r.category): r for r in g["gold_sales_daily_summary"].collect()}
    s1 = sales[("s1", "Grocery")]
    assert (s1.total_revenue, s1.total_cost, s1.gross_margin, s1.margin_pct) == (9.0, 4.0, 5.0, 55.56)
    unknown = [r for r in g["gold_sales_daily_summary"].collect() if r.category is None]
    assert len(unknown) == 1 and unknown[0].total_cost is None     # fact without a dimension row is kept
    inv = g["gold_inventory_daily_summary"].collect()
    assert {r.category: r.stockout_risk_pct for r in inv} == {"Grocery": 100.0, "Home": 0.0}
    ranks = {r.product_id: r.revenue_rank for r in g["gold_product_performance"].collect()}
    assert ranks["p1"] == 1
    assert {r.year_week for r in g["gold_weekly_trends"].collect()} == {"2024-W01"}


ENERGY = {
    "grid_sensors": """
reading_id,timestamp,substation_id,region,voltage_v,frequency_hz,power_factor,load_mw,temperature_c
g1,2024-01-01 00:10:00,ss1,N,230.0,50.0,0.9,10.0,5.0
g2,2024-01-01 00:20:00,ss1,N,231.0,50.1,0.9,11.0,5.0
g3,2024-01-01 00:30:00,ss1,N,229.0,49.9,0.9,12.0,5.0
g4,2024-01-01 00:40:00,ss1,N,280.0,50.0,0.9,13.0,5.0
g5,2024-01-01 01:10:00,ss2,S,,50.0,0.9,9.0,4.0
""",
    "power_events": """
event_id,timestamp,substation_id,region,event_type,severity,duration_sec,affected_customers,resolved
e1,2024-01-01 03:00:00,ss1,N,outage,critical,600,100,true
e2,2024-01-01 04:00:00,ss1,N,surge,low,60,0,false
e3,2024-01-01 05:00:00,ss1,N,,low,60,0,false
""",
    "renewable_generation": """
reading_id,timestamp,plant_id,plant_type,generation_mw,capacity_mw,capacity_factor,weather
w1,2024-01-01 12:00:00,pl1,solar,5.5,10.0,0.55,sunny
w2,2024-01-01 13:00:00,pl1,solar,,10.0,,cloudy
""",
}


def test_energy_package(spark):
    out = run_package(spark, get("energy"), _land(ENERGY))
    s = {r.reading_id: r for r in out["silver"]["grid_sensors"].collect()}
    assert "g5" not in s and s["g1"].voltage_deviation == 0.0
    g = out["gold"]
    o = g["gold_outage_summary"].collect()[0]
    assert (o.total_events, o.outages, o.surges, o.faults, o.total_affected, o.critical_events) == (2, 1, 1, 1, 100, 1)
    assert o.avg_duration_min == 5.5
    r = g["gold_renewable_summary"].collect()[0]
    assert (r.total_generation_mw, r.readings) == (5.5, 1)
    assert out["views"]["vw_grid_reliability"].count() == 1


FINANCIAL = {
    "customers": """
customer_id,age_group,segment,region,risk_tier,since_year
c1,25-34,Retail,North,Low,2015
""",
    "accounts": """
account_id,customer_id,account_type,balance,credit_limit,credit_utilisation_pct,open_date,status
a1,c1,Credit,100.0,1000,30,2020-01-01,Active
a2,c1,Credit,-5,1000,95,2020-01-01,Active
a3,c1,Current,50.0,0,0,2020-01-01,Closed
""",
    "transactions": """
transaction_id,account_id,customer_id,transaction_date,transaction_type,merchant_category,amount,is_flagged_fraud,channel,country
x1,a1,c1,2024-01-01 23:30:00,purchase,travel,6000,true,online,FR
x2,a1,c1,2024-01-01 12:00:00,purchase,grocery,20,false,store,UK
x3,a1,c1,2024-01-01 12:00:00,purchase,grocery,-3,false,store,UK
x4,a1,c1,not a date,purchase,grocery,3,false,store,UK
""",
}


def test_financial_package(spark):
    out = run_package(spark, get("financial"), _land(FINANCIAL))
    a = {r.account_id: r.utilisation_band for r in out["silver"]["accounts"].collect()}
    assert a == {"a1": "Low (≤30%)", "a3": "N/A"}
    x = {r.transaction_id: r for r in out["silver"]["transactions"].collect()}
    assert sorted(x) == ["x1", "x2"]
    assert (x["x1"].risk_score, x["x1"].risk_band) == (100, "Critical")
    assert (x["x2"].risk_score, x["x2"].risk_band) == (0, "Low")
    card = out["gold"]["gold_account_scorecards"].collect()[0]
    assert (card.total_transactions, card.fraud_rate, card.account_risk) == (2, 50.0, "High Risk")
    v = out["views"]["vw_executive_summary"].collect()[0]
    assert (v.total_transactions, v.total_volume, v.avg_transaction_value) == (2, 6020.0, 3010.0)


HEALTHCARE = {
    "staff_catalog": """
staff_id,role,department,shift,hire_date
st1,Nurse,ICU,Day,2019-01-01
""",
    "patient_admissions": """
patient_id,admission_id,department,admission_type,admission_date,discharge_date,length_of_stay_days,primary_dx_code,insurance_type,is_readmission,age_group,prior_admissions,assigned_staff_id
pa1,ad1,ICU,Emergency,2024-01-01 03:00:00,2024-01-02 03:00:00,1,I21,NHS,false,65+,0,st1
pa2,ad2,Cardiology,Elective,2024-01-01 10:00:00,2024-01-11 10:00:00,10,I50,Private,true,45-64,2,st1
pa3,ad3,Cardiology,Elective,2024-01-01 20:00:00,2024-01-01 22:00:00,0,I50,Private,false,45-64,0,st1
pa4,ad4,Cardiology,Elective,2024-01-02 20:00:00,,-1,I50,Private,false,45-64,0,st1
""",
    "clinical_records": """
record_id,admission_id,patient_id,department,recorded_at,vital_type,value,recorded_by
v1,ad1,pa1,ICU,2024-01-01 04:00:00,Heart Rate,130,st1
v2,ad1,pa1,ICU,2024-01-01 05:00:00,Temperature,37.0,st1
v3,ad1,pa1,ICU,2024-01-01 06:00:00,O2 Saturation,92,st1
v4,ad1,pa1,ICU,2024-01-01 07:00:00,Heart Rate,,st1
""",
}


def test_healthcare_package(spark):
    out = run_package(spark, get("healthcare"), _land(HEALTHCARE))
    a = {r.admission_id: r for r in out["silver"]["patient_admissions"].collect()}
    assert sorted(a) == ["ad1", "ad2", "ad3"]                          # negative stay dropped
    assert (a["ad1"].los_bucket, a["ad1"].admission_shift, a["ad1"].high_risk_flag) == ("1-2 Days", "Night", True)
    assert (a["ad2"].los_bucket, a["ad2"].high_risk_flag) == ("8-14 Days", True)
    assert (a["ad3"].los_bucket, a["ad3"].high_risk_flag, a["ad3"].admission_shift) == ("Same Day", False, "Evening")
    v = {r.record_id: r.is_abnormal for r in out["silver"]["clinical_records"].collect()}
    assert v == {"v1": True, "v2": False, "v3": True}
    card = {r.department: r for r in out["gold"]["gold_department_scorecard"].collect()}
    assert card["ICU"].readmission_rate == 0.0 and card["Cardiology"].readmission_rate == 50.0
    assert card["ICU"].performance_rank == 1 and card["Cardiology"].performance_rank == 2
    ex = out["views"]["vw_executive_summary"].collect()[0]
    assert (ex.total_admissions, ex.overall_readmission_rate, ex.overall_avg_los) == (3, 33.33, 3.67)


HOSPITALITY = {
    "properties": """
property_id,property_name,city,country,property_type,star_rating,room_count
h1, Grand ,Paris,fr,Hotel,5,10
h2,Inn,Lyon,FR,Inn,3,0
""",
    "guests": """
guest_id,loyalty_tier,region,age_group,nationality,total_stays,total_spend,preferred_channel,signup_date
g1,Gold,EU,35-44,FR,3,1000,web,2020-01-01
g2,Silver,EU,25-34,DE,1,100,ota,2021-01-01
""",
    "bookings": """
booking_id,property_id,guest_id,check_in_date,check_out_date,nights,room_type,channel,meal_plan,room_rate,total_amount,status,lead_time_days,is_refundable,is_cancelled,loyalty_tier
b1,h1,g1,2024-01-01,2024-01-03,2,Suite,web,BB,450,900,completed,10,1,0,Gold
b2,h1,g1,2024-01-05,2024-01-06,1,Double,web,BB,150,150,completed,5,1,0,Gold
b3,h1,g2,2024-01-05,2024-01-06,1,Double,ota,RO,99,99,cancelled,1,0,1,Silver
b4,h2,g2,2024-01-05,2024-01-07,2,Double,ota,RO,100,200,completed,1,0,0,Silver
""",
    "reviews": """
review_id,booking_id,property_id,guest_id,review_date,overall_score,cleanliness_score,service_score,value_score,food_score,sentiment,platform
r1,b1,h1,g1,2024-01-04,9.0,9,8,7,8,positive,web
r2,b2,h1,g1,2024-01-07,8.0,8,8,8,8,positive,web
""",
}


def test_hospitality_package(spark):
    out = run_package(spark, get("hospitality"), _land(HOSPITALITY))
    b = {r.booking_id: r for r in out["silver"]["bookings"].collect()}
    assert (b["b1"].length_of_stay, b["b1"].adr_band, b["b1"].revenue) == (2, "Luxury", 900.0)
    assert (b["b3"].adr_band, b["b3"].revenue, b["b3"].is_cancelled) == ("Budget", 0.0, 1)
    props = {r.property_id: (r.property_name, r.country) for r in out["silver"]["properties"].collect()}
    assert props["h1"] == ("Grand", "FR")
    card = {r.property_id: r for r in out["gold"]["gold_property_scorecards"].collect()}
    assert (card["h1"].total_bookings, card["h1"].revpar, card["h1"].performance_band) == (2, 105.0, "Excellent")
    assert card["h2"].revpar is None and card["h2"].performance_band == "Critical"   # zero rooms, no reviews
    assert (card["h1"].revpar_rank, card["h2"].revpar_rank) == (1, 2)
    assert card["h1"].repeat_guest_pct == 100.0
    loyal = {r.loyalty_tier: r for r in out["views"]["vw_loyalty_analysis"].collect()}
    assert (loyal["Gold"].unique_guests, loyal["Gold"].revenue_per_guest) == (1, 1050.0)


CONSTRUCTION = {
    "subcontractors": """
subcontractor_id,company_name,trade,region,rating,years_active,accredited
sc1,BuildCo,Electrical,N,4.6,10,Y
""",
    "projects": """
project_id,project_name,project_type,region,status,budget,planned_start_date,planned_end_date,lead_subcontractor_id
pr1,Tower,Commercial,N,In Progress,1000000,2024-01-01,2024-12-31,sc1
pr2,Bridge,Civil,N,Completed,500000,2024-01-01,2024-06-30,sc1
pr3,Depot,Civil,S,Planned,100000,2024-03-01,2024-04-01,sc1
""",
    "tasks": """
task_id,project_id,task_name,assigned_subcontractor_id,planned_start_date,planned_end_date,actual_start_date,forecast_end_date,schedule_variance_days,status,pct_complete,planned_duration_days,is_delayed
t1,pr1,Frame,sc1,2024-01-01,2024-03-01,2024-01-05,2024-05-15,75,In Progress,40,60,1
t2,pr1,Wiring,sc1,2024-02-01,2024-04-01,2024-02-01,2024-04-01,0,Completed,100,60,0
t3,pr2,Deck,sc1,2024-01-01,2024-03-01,2024-01-01,2024-03-20,20,Completed,100,60,1
""",
    "cost_ledger": """
cost_id,project_id,entry_date,cost_category,supplier,planned_cost,actual_cost,cost_variance,cost_variance_pct,approved
c1,pr1,2024-01-10,Labour,Acme,1000,1100,100,10,Y
c2,pr2,2024-01-10,Material,Acme,1000,1150,150,15,Y
""",
}


def test_construction_package(spark):
    out = run_package(spark, get("construction"), _land(CONSTRUCTION))
    pr = {r.project_id: r for r in out["silver"]["projects"].collect()}
    assert (pr["pr1"].schedule_variance_days, pr["pr1"].schedule_risk_band, pr["pr1"].cost_risk_band) == \
        (75, "Critical", "Over Budget")
    assert (pr["pr2"].schedule_risk_band, pr["pr2"].cost_variance_pct, pr["pr2"].cost_risk_band) == \
        ("Medium", 15.0, "High")
    assert (pr["pr3"].schedule_risk_band, pr["pr3"].cost_risk_band) == ("On Track", "On Budget")
    port = {r.project_id: r for r in out["gold"]["gold_portfolio_scorecards"].collect()}
    # worst of the two bands: a Critical schedule is never hidden by a milder cost band
    assert port["pr1"].performance_band == "Critical"
    assert port["pr2"].performance_band == "Needs Attention"
    assert port["pr3"].performance_band == "Excellent" and port["pr3"].total_tasks is None
    assert {r.project_id for r in out["gold"]["gold_overrun_alerts"].collect()} == {"pr1", "pr2"}
    risk = {r.project_id: r.forecast_end_date for r in out["views"]["vw_schedule_risk"].collect()}
    assert str(risk["pr1"]) == "2024-05-15"


EDUCATION = {
    "students": """
student_id,programme,department,level,cohort_year,enrolment_date,status,gender,region,age_at_enrolment
s1,CS,Eng,UG,2023,2023-09-01,Active,F,N,18
s2,CS,Eng,UG,2023,2023-09-01,Withdrawn,M,N,19
s3,CS,Eng,UG,2023,2023-09-01,Active,M,S,18
""",
    "faculty": """
faculty_id,department,role,years_at_institution,courses_assigned,research_active,hire_date
f1,Eng,Lecturer,5,4,Y,2019-01-01
f2,Eng,Professor,10,0,Y,2014-01-01
""",
    "enrolments": """
enrolment_id,student_id,course_id,department,level,credits,enrolment_date,status,is_completed,is_withdrawn,age_at_enrolment
e1,s1,c1,Eng,UG,15,2023-09-01,Completed,1,0,18
e2,s2,c1,Eng,UG,15,2023-09-01,Withdrawn,0,1,19
""",
    "assessments": """
assessment_id,enrolment_id,student_id,course_id,department,assessment_type,attempt_number,submitted_date,score,grade,is_pass,word_count
a1,e1,s1,c1,Eng,Exam,1,2023-12-30,72,A,1,0
a2,e1,s1,c1,Eng,Essay,2,2024-01-02,38,F,0,2000
a3,e2,s2,c1,Eng,Exam,1,2023-12-30,,F,0,0
""",
}


def test_education_package(spark):
    out = run_package(spark, get("education"), _land(EDUCATION))
    a = {r.assessment_id: r for r in out["silver"]["assessments"].collect()}
    assert (a["a1"].grade_band, a["a2"].grade_band, a["a2"].is_resit, a["a3"].grade_band) == \
        ("Distinction", "Fail", 1, "Unknown")
    cards = {r.student_id: r for r in out["gold"]["gold_student_scorecards"].collect()}
    assert (cards["s1"].avg_score, cards["s1"].pass_rate, cards["s1"].retention_risk) == (55.0, 50.0, "Medium")
    assert cards["s2"].retention_risk == "High"
    assert (cards["s3"].retention_risk, cards["s3"].performance_band) == ("Unknown", "Unknown")   # no assessments
    wl = {r.faculty_id: r.students_per_course for r in out["gold"]["gold_faculty_workload"].collect()}
    assert wl == {"f1": 0.5, "f2": None}
    co = out["gold"]["gold_cohort_outcomes"].collect()[0]
    assert (co.total_students, co.withdrawn_students, co.retention_rate) == (3, 1, 66.67)


MEDIA = {
    "content_catalog": """
content_id,title,genre,content_type,release_year,duration_mins,production_cost_bucket,language
m1, Alpha ,Drama,Film,2020,100,High,EN
m2,Beta,Drama,Film,2021,50,Low,EN
""",
    "subscribers": """
subscriber_id,plan_type,region,age_group,payment_method,monthly_fee,signup_date,churn_date,is_churned
u1,Premium,EU,25-34,card,20.0,2024-01-01,2024-02-15,1
u2,Standard,EU,25-34,card,10.0,2024-01-01,,0
u3,Basic,EU,25-34,card,5.0,2023-01-01,,0
""",
    "viewing_history": """
view_id,subscriber_id,content_id,view_date,view_hour,watch_duration_mins,is_completed,device_type,rating
v1,u1,m1,2024-01-02,20,90,1,tv,5
v2,u2,m1,2024-01-03,20,30,0,tv,
v3,u2,m2,2024-01-03,21,10,0,phone,3
""",
    "ad_impressions": """
impression_id,content_id,ad_date,ad_type,impressions,clicks,revenue_usd,cpm
a1,m1,2024-01-02,pre-roll,1000,40,2.5,2.5
a2,m2,2024-01-02,pre-roll,1000,10,1.0,1.0
""",
}


def test_media_package(spark, monkeypatch):
    from strata.plans.packages import media

    monkeypatch.setattr(media, "AS_OF", "2024-03-01")
    out = run_package(spark, get("media"), _land(MEDIA))
    subs = {r.subscriber_id: r for r in out["silver"]["subscribers"].collect()}
    assert (subs["u1"].tenure_days, subs["u1"].tenure_bucket, subs["u1"].plan_tier) == (45, "0-3 months", "High")
    assert (subs["u2"].churn_date, subs["u2"].tenure_days) == (None, 60)         # blank optional date → NULL
    assert (subs["u3"].tenure_bucket, subs["u3"].plan_tier) == ("1-2 years", "Low")
    views = {r.view_id: r for r in out["silver"]["viewing_history"].collect()}
    assert (views["v1"].completion_pct, views["v1"].engagement_band) == (90.0, "Completed")
    assert views["v2"].rating is None and views["v3"].engagement_band == "Sampled"
    perf = {r.content_id: r for r in out["gold"]["gold_content_performance"].collect()}
    assert (perf["m1"].avg_rating, perf["m1"].rank_in_genre, perf["m2"].rank_in_genre) == (5.0, 1, 2)
    ads = {r.ctr_band: r for r in out["gold"]["gold_ad_revenue"].collect()}
    assert set(ads) == {"High (≥3%)", "Low (<1.5%)"}
    card = {r.plan_type: r for r in out["gold"]["gold_subscriber_scorecards"].collect()}
    assert (card["Premium"].churn_rate, card["Premium"].arpu, card["Premium"].health_band) == (100.0, None, "Critical")


TECHNOLOGY = {
    "accounts": """
account_id,plan,mrr_usd,industry,region,signup_date,churn_date,is_churned,seat_count,health_score
ac1,Enterprise,1000,Fin,EU,2023-01-01,,0,50,40
ac2,Growth,100,Retail,US,2023-01-01,2023-07-01,1,5,30
""",
    "users": """
user_id,account_id,role,is_active,last_login_date,signup_date,logins_last_30_days
us1,ac1,admin,1,2024-01-01,2023-01-01,25
us2,ac1,user,0,2023-06-01,2023-01-01,0
""",
    "events": """
event_id,user_id,account_id,event_date,feature,action,session_id,duration_secs
e1,us1,ac1,2024-01-03,Dashboard,view,s1,30
e2,us1,ac1,2024-01-04,API,call,s2,10
e3,us2,ac1,2024-01-04,Billing,view,s3,20
""",
    "support_tickets": """
ticket_id,account_id,created_at,resolved_at,category,priority,resolution_hrs,sla_target_hrs,is_sla_breached,csat_score
k1,ac1,2024-01-01 00:00:00,2024-01-01 01:00:00,Bug,High,1,4,0,5
k2,ac1,2024-01-02 00:00:00,2024-01-05 00:00:00,Bug,High,72,4,1,2
""",
}


def test_technology_package(spark, monkeypatch):
    from strata.plans.packages import technology

    monkeypatch.setattr(technology, "AS_OF", "2024-01-31")
    out = run_package(spark, get("technology"), _land(TECHNOLOGY))
    acc = {r.account_id: r for r in out["silver"]["accounts"].collect()}
    assert (acc["ac1"].plan_tier, acc["ac1"].churn_risk_flag, acc["ac1"].days_as_customer) == (4, 1, 395)
    assert (acc["ac2"].plan_tier, acc["ac2"].churn_risk_flag, acc["ac2"].days_as_customer) == (2, 0, 181)
    ev = {r.event_id: r.feature_category for r in out["silver"]["events"].collect()}
    assert ev == {"e1": "Analytics", "e2": "Platform", "e3": "Administration"}
    tk = {r.ticket_id: r.response_band for r in out["silver"]["support_tickets"].collect()}
    assert tk == {"k1": "Same-Day", "k2": "This-Week"}
    share = {r.feature: r.user_share_pct for r in out["gold"]["gold_feature_adoption"].collect()}
    assert share == {"Dashboard": 33.33, "API": 33.33, "Billing": 33.33}
    cards = {r.account_id: r for r in out["gold"]["gold_account_scorecards"].collect()}
    assert (cards["ac1"].total_tickets, cards["ac1"].features_used, cards["ac2"].total_events) == (2, 3, None)


PROFESSIONAL = {
    "clients": """
client_id,client_name,industry,region,tier,contract_value_gbp,relationship_years,nps_score
cl1,Acme,Tech,UK,Gold,900,5,60
cl2,Beta,Retail,UK,Silver,100,2,-10
""",
    "consultants": """
consultant_id,grade,practice,region,daily_rate_gbp,years_experience,is_billable,hire_date
k1,Analyst,Data,UK,500,2,1,2022-01-01
k2,Partner,Data,UK,2000,20,1,2004-01-01
""",
    "engagements": """
engagement_id,client_id,lead_consultant_id,practice,start_date,planned_end_date,budget_gbp,actual_spend_gbp,margin_pct,status,headcount,planned_duration_days,is_over_budget
en1,cl1,k2,Data,2024-01-01,2024-03-01,100,120,-5,At Risk,3,60,1
en2,cl1,k1,Data,2024-01-01,2024-02-01,100,90,25,On Track,2,31,0
""",
    "timesheets": """
timesheet_id,consultant_id,engagement_id,week_starting,task_type,hours_logged,is_billable,daily_rate_gbp,billed_value_gbp
ts1,k1,en1,2024-01-01,Build,30,1,500,1875
ts2,k1,en2,2024-01-01,Admin,10,0,500,0
""",
}


def test_professional_package(spark):
    out = run_package(spark, get("professional"), _land(PROFESSIONAL))
    cli = {r.client_id: r for r in out["silver"]["clients"].collect()}
    assert (cli["cl1"].concentration_pct, cli["cl1"].client_concentration_flag, cli["cl1"].nps_band) == \
        (90.0, 1, "Promoter")
    assert cli["cl2"].nps_band == "Detractor"
    eng = {r.engagement_id: r for r in out["silver"]["engagements"].collect()}
    assert (eng["en1"].margin_band, eng["en1"].delivery_health_flag, eng["en1"].overrun_pct) == \
        ("Loss-Making (<0%)", 1, 20.0)
    ts = {r.timesheet_id: r.billable_utilisation_rate for r in out["silver"]["timesheets"].collect()}
    assert ts == {"ts1": 75.0, "ts2": 0.0}
    util = out["gold"]["gold_consultant_utilisation"].collect()[0]
    assert (util.total_hours_logged, util.billable_hours, util.utilisation_rate_pct) == (40.0, 30.0, 75.0)
    rev = {r.client_id: r for r in out["gold"]["gold_client_revenue"].collect()}
    assert (rev["cl1"].total_engagements, rev["cl2"].total_engagements) == (2, None)


TRANSPORTATION = {
    "vehicles": """
vehicle_id,vehicle_type,depot,capacity_tonnes,year_registered,status,driver_id
v1,Truck,North,20,2015,Active,d1
v2,Van,North,0,2020,Inactive,d2
""",
    "routes": """
route_id,origin,destination,distance_km,route_type,sla_hours,toll_cost_gbp
r1,Leeds,York,40,Regional,2,5
""",
    "deliveries": """
delivery_id,vehicle_id,route_id,planned_departure,actual_arrival,planned_duration_hrs,actual_duration_hrs,delay_hrs,distance_km,load_tonnes,status,is_late
d1,v1,r1,2024-01-01 08:00:00,2024-01-01 10:00:00,2,2,0,40,10,Delivered,0
d2,v1,r1,2024-01-02 08:00:00,2024-01-02 13:00:00,2,5,3,40,15,Delivered,1
d3,v2,r1,2024-01-02 09:00:00,2024-01-02 15:00:00,2,6,4.5,60,1,Delivered,1
""",
    "fuel_logs": """
log_id,vehicle_id,log_date,depot,odometer_km,litres_filled,cost_per_litre,total_cost_gbp,fuel_type
f1,v1,2024-01-03,North,10000,20,1.5,30,Diesel
""",
}


def test_transportation_package(spark):
    out = run_package(spark, get("transportation"), _land(TRANSPORTATION))
    d = {r.delivery_id: r for r in out["silver"]["deliveries"].collect()}
    assert (d["d1"].delay_band, d["d1"].load_utilisation_pct) == ("On Time", 50.0)
    assert (d["d2"].delay_band, d["d3"].delay_band, d["d3"].load_utilisation_pct) == \
        ("Moderate (1–4 h)", "Severe (>4 h)", None)
    fl = out["silver"]["fuel_logs"].collect()[0]
    assert (fl.fuel_efficiency_km_per_litre, fl.cost_check) == (2.0, 1.5)
    fleet = {r.vehicle_id: r.on_time_rate_pct for r in out["gold"]["gold_fleet_summary"].collect()}
    assert fleet == {"v1": 50.0, "v2": 0.0}
    assert {r.delivery_id for r in out["gold"]["gold_late_delivery_alerts"].collect()} == {"d2", "d3"}
    ex = out["views"]["vw_executive_summary"].collect()[0]
    assert (ex.total_deliveries, ex.avg_on_time_rate_pct, ex.avg_delay_hrs) == (3, 33.3, 2.5)


@pytest.mark.parametrize("name", PACKAGES)
def test_package_declares_layers(name):
    pkg = get(name)
    assert pkg.sources and pkg.keys
    assert set(pkg.keys) <= set(pkg.sources)


def _financial_many(n=400):
    import random

    rnd = random.Random(42)
    rows = ["transaction_id,account_id,customer_id,transaction_date,transaction_type,merchant_category,amount,"
            "is_flagged_fraud,channel,country"]
    for i in range(n):
        night = rnd.random() < 0.3
        amount = round(rnd.uniform(5, 9000), 2)
        fraud = (night and amount > 4000) or rnd.random() < 0.03
        hour = rnd.choice([1, 2, 23]) if night else rnd.randint(8, 20)
        rows.append(f"x{i},a1,c1,2024-01-{1 + i % 28:02d} {hour:02d}:00:00,purchase,"
                    f"{rnd.choice(['travel', 'grocery', 'tech'])},{amount},{str(fraud).lower()},"
                    f"{rnd.choice(['online', 'store'])},{rnd.choice(['UK', 'FR'])}")
    files = dict(FINANCIAL)
    files["transactions"] = "\n".join(rows)
    return files


def test_package_model_lifecycle(spark):
    from strata.plans.packages.modeling import SPECS, run_ml, score_stored

    out = run_package(spark, get("financial"), _land(_financial_many()))
    res = run_ml(spark, SPECS["financial"], out["silver"], name="fraud", version="lifecycle")
    guard = res["gold_ml_label_guard"].collect()[0]
    assert guard.rows == 400 and guard.passed is True
    mets = {r.model: r for r in res["gold_ml_model_metrics"].collect()}
    assert set(mets) == {"random_forest", "gbt"} and all(0.5 <= m.auc <= 1.0 for m in mets.values())
    preds = res["gold_ml_predictions"]
    assert preds.count() == 400
    again = score_stored(spark, SPECS["financial"], out["silver"], "fraud", "lifecycle")
    assert sorted(map(str, again.collect())) == sorted(map(str, preds.collect()))
    assert {r.risk_level for r in preds.select("risk_level").distinct().collect()} <= {"critical", "high", "medium", "low"}
    summ = res["gold_ml_summary"].collect()
    assert sum(r.total for r in summ) == 400
    imp = res["gold_ml_feature_importance"].collect()
    assert abs(sum(r.importance_norm for r in imp) - 1.0) < 1e-9


# ------------------------------------------------------------------ mirroring
# DuckDB oracles for each package's headline, run over the typed, keyed
# mirror tables (registered by their view names).
MIRROR_ORACLES = {
    "manufacturing": """
        SELECT production_line, count(*) AS batches, sum(units_produced) AS units, sum(defect_count) AS defects,
               round(sum(defect_count) * 100.0 / nullif(sum(units_produced), 0), 2) AS defect_rate_pct,
               sum(downtime_minutes) AS downtime_min
        FROM m_production_batches GROUP BY production_line""",
    "retail": """
        SELECT p.category, s.region, count(*) AS transactions,
               round(sum(x.quantity * x.unit_price * (1 - x.discount_pct / 100)), 0) AS revenue
        FROM m_pos_transactions x JOIN m_products p ON p.sku = x.product_id JOIN m_stores s USING (store_id)
        GROUP BY p.category, s.region""",
    "energy": """
        SELECT region, severity, count(*) AS events, sum(affected_customers) AS customers_affected,
               count(*) FILTER (WHERE resolved) AS resolved_events
        FROM m_power_events GROUP BY region, severity""",
    "financial": """
        SELECT merchant_category, count(*) AS transactions, round(sum(amount), 0) AS total_amount,
               count(*) FILTER (WHERE is_flagged_fraud) AS flagged_fraud
        FROM m_transactions GROUP BY merchant_category""",
    "healthcare": """
        SELECT department, count(*) AS admissions, round(avg(length_of_stay_days::DOUBLE), 1) AS avg_los_days,
               count(*) FILTER (WHERE is_readmission) AS readmissions
        FROM m_patient_admissions GROUP BY department""",
    "hospitality": """
        SELECT p.property_name, p.city, count(*) AS bookings, sum(b.nights) AS room_nights,
               round(sum(b.total_amount), 0) AS revenue, count(*) FILTER (WHERE b.is_cancelled) AS cancellations
        FROM m_bookings b JOIN m_properties p USING (property_id) GROUP BY p.property_name, p.city""",
    "construction": """
        SELECT p.project_type, count(DISTINCT t.project_id) AS projects, count(*) AS tasks,
               count(*) FILTER (WHERE t.is_delayed) AS delayed_tasks,
               round(avg(t.schedule_variance_days::DOUBLE), 1) AS avg_schedule_var_days
        FROM m_tasks t JOIN m_projects p USING (project_id) GROUP BY p.project_type""",
    "education": """
        SELECT department, count(*) AS enrolments, count(*) FILTER (WHERE is_completed) AS completed,
               count(*) FILTER (WHERE is_withdrawn) AS withdrawn,
               round((count(*) FILTER (WHERE is_withdrawn)) * 100.0 / nullif(count(*), 0), 2) AS withdrawal_rate_pct
        FROM m_enrolments GROUP BY department""",
    "media": """
        SELECT c.genre, count(*) AS views, sum(v.watch_duration_mins) AS watch_minutes,
               round((count(*) FILTER (WHERE v.is_completed)) * 100.0 / nullif(count(*), 0), 1) AS completion_rate_pct
        FROM m_viewing_history v JOIN m_content_catalog c USING (content_id) GROUP BY c.genre""",
    "technology": """
        SELECT priority, count(*) AS tickets, round(avg(resolution_hrs), 1) AS avg_resolution_hrs,
               count(*) FILTER (WHERE is_sla_breached) AS sla_breaches, round(avg(csat_score::DOUBLE), 2) AS avg_csat
        FROM m_support_tickets GROUP BY priority""",
    "professional": """
        SELECT practice, count(*) AS engagements, round(avg(margin_pct), 1) AS avg_margin_pct,
               count(*) FILTER (WHERE is_over_budget) AS over_budget, round(sum(actual_spend_gbp), 0) AS total_spend
        FROM m_engagements GROUP BY practice""",
    "transportation": """
        SELECT r.origin, r.destination, count(*) AS deliveries, count(*) FILTER (WHERE d.is_late) AS late_deliveries,
               round(avg(d.delay_hrs), 2) AS avg_delay_hrs
        FROM m_deliveries d JOIN m_routes r USING (route_id) GROUP BY r.origin, r.destination""",
}

MIRROR_FIXTURES = {"manufacturing": MANUFACTURING, "retail": RETAIL, "energy": ENERGY, "financial": FINANCIAL,
                   "healthcare": HEALTHCARE, "hospitality": HOSPITALITY, "construction": CONSTRUCTION,
                   "education": EDUCATION, "media": MEDIA, "technology": TECHNOLOGY,
                   "professional": PROFESSIONAL, "transportation": TRANSPORTATION}


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal"
                         else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", PACKAGES)
def test_package_mirror(spark, name):
    import duckdb

    from strata.plans.packages.mirroring import MIRRORS, headline, live_change, load_mirror

    pkg = get(name)
    tables = load_mirror(spark, pkg, _land(MIRROR_FIXTURES[name]))
    for t, df in tables.items():                      # one row per primary key
        pk = MIRRORS[name].keys[t]
        assert df.count() == df.select(*pk).distinct().count()
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(f"m_{t}", df.toArrow())
    head = headline(pkg, tables)
    got = head.collect()
    want = con.execute(MIRROR_ORACLES[name]).fetchall()
    assert [d[0] for d in con.description] == head.columns
    assert got and _norm(got) == _norm(want)
    # reporting order: the ordering column never increases
    order_col = {"manufacturing": "defect_rate_pct", "retail": "revenue", "energy": "customers_affected",
                 "financial": "total_amount", "healthcare": "admissions", "hospitality": "revenue",
                 "construction": "delayed_tasks", "education": "withdrawal_rate_pct", "media": "watch_minutes",
                 "technology": "sla_breaches", "professional": "avg_margin_pct",
                 "transportation": "late_deliveries"}[name]
    vals = [r[order_col] for r in got if r[order_col] is not None]
    assert vals == sorted(vals, reverse=True)

    # live change: exactly the target row's column differs afterwards
    c = MIRRORS[name].change
    after, diff = live_change(pkg, tables)
    d = diff.collect()
    assert len(d) == 1 and d[0]["diff"] == c.column
    key = d[0][c.key]
    old = tables[c.table].filter(F.col(c.key) == key).collect()[0][c.column]
    new = after[c.table].filter(F.col(c.key) == key).collect()[0][c.column]
    if c.kind == "flag":
        assert new in (1, True) and old not in (1, True)
        first = (tables[c.table].filter(F.col(c.column).isNull() | ~F.col(c.column).cast("boolean"))
                 .agg(F.min(c.key)).collect()[0][0])
        assert key == first
    else:
        assert float(new) == round(float(old) * c.factor + 1, 2)
    assert after[c.table].count() == tables[c.table].count()
    counted = {"energy": "resolved_events", "financial": "flagged_fraud", "hospitality": "cancellations",
               "construction": "delayed_tasks", "education": "withdrawn", "professional": "over_budget",
               "transportation": "late_deliveries"}.get(name)
    if counted:                                       # the headline sees the change
        assert sum(r[counted] for r in headline(pkg, after).collect()) == sum(r[counted] for r in got) + 1


# ------------------------------------------------------------------ model features
FEATURE_FIXTURES = {"manufacturing": MANUFACTURING, "retail": RETAIL, "energy": ENERGY, "financial": FINANCIAL,
                    "healthcare": HEALTHCARE, "hospitality": HOSPITALITY, "construction": CONSTRUCTION, "education": EDUCATION,
                    "media": MEDIA, "technology": TECHNOLOGY, "professional": PROFESSIONAL, "transportation": TRANSPORTATION}
#: of the first row by key, worked out by hand from the landing rows
FIRST_FEATURES = {
    "manufacturing": {"reading_count": 4.0, "avg_pressure": 100.0, "range_pressure": 2.0},
    "retail": {"avg_price": 5.0, "unit_cost": 2.0, "margin_pct": 60.0, "week_of_year": 1.0, "demand_lag_1": 0.0},
    "energy": {"avg_voltage_v": 242.5, "range_voltage_v": 51.0, "voltage_deviation": 12.5, "freq_deviation": 0.0},
    "financial": {"log_amount": math.log1p(6000), "is_night": 1.0, "balance": 100.0, "segment": "Retail", "risk_tier": "Low"},
    "healthcare": {"vital_count": 3.0, "abnormal_vital_count": 2.0, "abnormal_vital_ratio": 2 / 3, "dx_chapter": "I"},
    "hospitality": {"total_stays": 3.0, "star_rating": 5.0, "property_type": "Hotel", "loyalty_tier": "Gold"},
    "construction": {"budget": 1000000.0, "sub_rating": 4.6, "sub_accredited_flag": 1.0, "project_region": "N"},
    "education": {"avg_score": 55.0, "pass_rate": 0.5, "assessment_count": 2.0, "programme": "CS"},
    "media": {"release_year": 2020.0, "monthly_fee": 20.0, "genre": "Drama", "plan_type": "Premium"},
    "technology": {"user_count": 2.0, "active_user_count": 1.0, "avg_logins_30d": 12.5, "distinct_features": 3.0,
                   "ticket_count": 2.0, "sla_breach_count": 1.0, "avg_csat": 3.5},
    "professional": {"lead_grade": "Partner", "lead_experience": 20.0, "contract_value_gbp": 900.0, "tier": "Gold"},
    "transportation": {"vehicle_age": 11.0, "load_utilisation": 0.5, "departure_hour": 8.0, "is_rush": 1.0, "depot": "North"},
}
LEAKS = {"defect_count", "downtime_minutes", "yield_pct", "rating", "pct_complete", "delay_hrs", "actual_spend_gbp", "risk_score"}


@pytest.mark.parametrize("name", sorted(FEATURE_FIXTURES))
def test_package_feature_table(spark, name):
    from strata.plans.packages.modeling import SPECS, feature_table, run_ml

    spec = SPECS[name]
    silver = run_package(spark, get(name), _land(FEATURE_FIXTURES[name]))["silver"]
    f = feature_table(spec, silver)
    assert {*spec.numeric, *spec.categorical, spec.label, spec.key} <= set(f.columns) and not LEAKS & set(f.columns)
    got = f.orderBy(spec.key).collect()
    assert len({r[spec.key] for r in got}) == len(got)  # no fan-out
    assert not any(v is None for r in got for c, v in r.asDict().items() if c in (*spec.numeric, *spec.categorical))
    for c, v in FIRST_FEATURES[name].items():
        assert got[0][c] == (pytest.approx(v) if isinstance(v, float) else v), c
    with pytest.raises(ValueError, match="label guard"):  # a handful of rows teaches nothing
        run_ml(spark, spec, silver)


def test_package_prediction_summaries(spark):
    from strata.plans.packages.modeling import SPECS

    p = spark.createDataFrame([("Drama", 1, 1, 0.9, 100.0), ("Drama", 0, 1, 0.5, 50.0), ("News", 0, 0, 0.1, 30.0)],
                              "genre string, predicted int, had_complete int, probability_positive double, duration_mins double")
    got = {r.genre: r for r in SPECS["media"].summary(p).collect()}
    assert (got["Drama"].completion_rate, got["Drama"].avg_complete_probability, got["Drama"].overall_engagement) == (50.0, 0.7, "high")
    assert got["News"].overall_engagement == "low"
    d = spark.createDataFrame([("G", "N", 12.0, 5.0, "high_demand", 10.0), ("G", "N", 5.0, 5.0, "stable", 20.0)],
                              "category string, region string, predicted double, daily_quantity double, demand_signal string, daily_revenue double")
    r = SPECS["retail"].summary(d).first()
    assert (r.avg_demand_gap, r.demand_trend, r.high_demand_days, r.total_revenue) == (3.5, "growing", 1, 30.0)


def test_written_layers_are_read_by_the_next_one(spark):
    to = tempfile.mkdtemp(prefix="strata-layers-")
    landing = _land(MANUFACTURING)
    plain = run_package(spark, get("manufacturing"), landing)
    out = run_package(spark, get("manufacturing"), landing, write_to=to)
    for layer in ("silver", "gold"):
        for t, df in out[layer].items():
            assert all(f"{to}/manufacturing__{layer}_{t}" in f for f in df.inputFiles()), t
            assert df.count() == plain[layer][t].count(), (layer, t)
    # what builds gold scans written silver (and statistics written from it), not the landing files or bronze
    files = [f for df in get("manufacturing").gold(out["silver"]).values() for f in df.inputFiles()]
    assert any("__silver_" in f for f in files) and not any(f.endswith(".csv") or "__bronze_" in f for f in files)
