"""Stream queries (T-series) on the ``events`` table.

Batch forms run the same functions on a static DataFrame; streaming forms
read ``events`` through the file stream source, run the query under a
watermark and return the table the stream wrote — so each stream query has
the same SQL oracle as its batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.catalog import query, table
from strata.streaming import (_scratch, alert_stream, apply_changes, current_rows, group_signal,
                              latest_n, read_alerts, read_stream, read_upserted, replica_diff, run_to_completion,
                              sigma_outliers, store_count, stream_append, tumbling_avg, tumbling_count,
                              upsert_windows)

SQL_PER_MINUTE = """
SELECT date_trunc('minute', ts) AS window_start, count(*) AS records FROM events GROUP BY 1
"""


@query("events_per_minute", "T3", SQL_PER_MINUTE)
def events_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_count(table(spark, sf_dir, "events"), "ts", "1 minute")


@query("signal_avg_5min", "T4", """
SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS window_start,
       CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value) AS avg_value,
       count(*) AS n
FROM events GROUP BY 1
""")
def signal_avg_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_avg(table(spark, sf_dir, "events"), "ts", "value", "5 minutes")


@query("signal_by_user_top20", "T5 O3", """
SELECT user_id, CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value)
         AS avg_value, max(value) AS max_value
FROM events GROUP BY user_id ORDER BY avg_value DESC, user_id LIMIT 20
""")
def signal_by_user_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_signal(table(spark, sf_dir, "events"), "user_id", "value", 20)


@query("three_sigma_outliers", "T6 J8", """
WITH st AS (SELECT user_id, avg(value) AS avg_val, stddev_samp(value) AS stdev_val FROM events GROUP BY user_id)
SELECT e.user_id, e.value, round(st.avg_val, 6) AS avg_val, round(st.stdev_val, 6) AS stdev_val
FROM events e JOIN st USING (user_id) WHERE e.value > st.avg_val + 3 * st.stdev_val
""")
def three_sigma_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sigma_outliers(table(spark, sf_dir, "events"), "user_id", "value", 3.0)
    return out.withColumns({"avg_val": F.round("avg_val", 6), "stdev_val": F.round("stdev_val", 6)})


@query("latest_100_events", "T7", """
SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def latest_100_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_n(table(spark, sf_dir, "events"), "ts", 100, tiebreak=["event_id"])


@query("event_store_count", "T8", "SELECT count(*) AS row_count FROM events")
def event_store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_count(table(spark, sf_dir, "events"))


# ------------------------------------------------------------------ streaming forms
def _events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events table, a file or a folder of files, as a stream of its files
    (a pattern, because a plain path has to be a folder for a file stream)."""
    return read_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, max_files=max_files)


@query("stream_append_events", "T1", "SELECT * FROM events")
def stream_append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _scratch(spark, "sink-append")
    run_to_completion(stream_append(_events_stream(spark, sf_dir), sink))
    return spark.read.parquet(sink)


@query("stream_events_per_minute", "T3 T1", SQL_PER_MINUTE)
def stream_events_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _scratch(spark, "sink-minute")
    agg = tumbling_count(_events_stream(spark, sf_dir), "ts", "1 minute")
    run_to_completion(upsert_windows(agg, sink, ["window_start"]))
    return read_upserted(spark, sink, ["window_start"])


@query("stream_signal_avg_5min", "T4 T1", """
SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS window_start,
       CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value) AS avg_value,
       count(*) AS n
FROM events GROUP BY 1
""")
def stream_signal_avg_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _scratch(spark, "sink-5min")
    agg = tumbling_avg(_events_stream(spark, sf_dir), "ts", "value", "5 minutes")
    run_to_completion(upsert_windows(agg, sink, ["window_start"]))
    return read_upserted(spark, sink, ["window_start"])


@query("stream_error_alerts", "T9 P8", """
SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' AND value > 40
""")
def stream_error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = _scratch(spark, "sink-alert")
    pred = (F.col("event_type") == "error") & (F.col("value") > 40)
    run_to_completion(alert_stream(_events_stream(spark, sf_dir), pred, sink,
                                   cols=["event_id", "ts", "user_id", "value"]))
    return read_alerts(spark, sink)


# ------------------------------------------------------------------ change propagation
def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed changes derived from orders: pending orders are fulfilled with a 100.00 surcharge (seq 1),
    low-priority open orders are deleted (seq 2), and urgent pending orders are
    re-opened afterwards (seq 3: the status of seq 1 is overridden, its
    surcharge stays)."""
    o = table(spark, sf_dir, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    fulfil = o.filter(st == "P").select("o_orderkey", F.lit(1).alias("seq"), F.lit("U").alias("op"),
                                        F.lit("F").alias("o_orderstatus"),
                                        (F.col("o_totalprice") + F.lit(100.0)).alias("o_totalprice"))
    delete = o.filter((st == "O") & (pr == "5-LOW")).select(
        "o_orderkey", F.lit(2).alias("seq"), F.lit("D").alias("op"),
        F.lit(None).cast("string").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    reopen = o.filter((st == "P") & (pr == "1-URGENT")).select(
        "o_orderkey", F.lit(3).alias("seq"), F.lit("U").alias("op"), F.lit("O").alias("o_orderstatus"),
        F.lit(None).cast("double").alias("o_totalprice"))
    return fulfil.unionByName(delete).unionByName(reopen)


# the three statements one after another, each on the rows the one before left
SQL_ORDER_CHANGES = """
WITH fulfilled AS (
  SELECT *, o_orderstatus AS was, o_orderstatus = 'P' AS touched,
         CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS st,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice + CAST(100 AS DOUBLE) ELSE o_totalprice END AS price FROM orders),
deleted AS (SELECT *, was = 'O' AND o_orderpriority = '5-LOW' AS gone FROM fulfilled),
reopened AS (SELECT * REPLACE (CASE WHEN was = 'P' AND o_orderpriority = '1-URGENT' THEN 'O' ELSE st END AS st) FROM deleted),
applied AS (
  SELECT o_orderkey, o_custkey, st AS o_orderstatus, price AS o_totalprice, o_orderdate, o_orderpriority,
         CASE WHEN gone THEN 'deleted' WHEN touched THEN 'updated' ELSE 'unchanged' END AS change FROM reopened)
"""


@query("orders_apply_changes", "T10", SQL_ORDER_CHANGES + "SELECT * FROM applied")
def orders_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), ["o_orderkey"], "seq")


@query("orders_replica_diff", "T11", SQL_ORDER_CHANGES + """
, cur AS (SELECT * EXCLUDE (change) FROM applied WHERE change <> 'deleted')
SELECT o.o_orderkey,
  CASE WHEN c.o_orderkey IS NULL THEN 'missing_in_replica'
       ELSE concat_ws(',',
         CASE WHEN o.o_custkey IS DISTINCT FROM c.o_custkey THEN 'o_custkey' END,
         CASE WHEN o.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 'o_orderstatus' END,
         CASE WHEN NOT coalesce((o.o_totalprice IS NULL AND c.o_totalprice IS NULL)
                                OR abs(o.o_totalprice - c.o_totalprice) <= 0.01, false) THEN 'o_totalprice' END,
         CASE WHEN o.o_orderdate IS DISTINCT FROM c.o_orderdate THEN 'o_orderdate' END,
         CASE WHEN o.o_orderpriority IS DISTINCT FROM c.o_orderpriority THEN 'o_orderpriority' END) END AS diff
FROM orders o LEFT JOIN cur c ON o.o_orderkey = c.o_orderkey
WHERE c.o_orderkey IS NULL OR o.o_custkey IS DISTINCT FROM c.o_custkey OR o.o_orderstatus IS DISTINCT FROM c.o_orderstatus
   OR NOT coalesce((o.o_totalprice IS NULL AND c.o_totalprice IS NULL) OR abs(o.o_totalprice - c.o_totalprice) <= 0.01, false)
   OR o.o_orderdate IS DISTINCT FROM c.o_orderdate OR o.o_orderpriority IS DISTINCT FROM c.o_orderpriority
""")
def orders_replica_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    replica = current_rows(apply_changes(o, order_changes(spark, sf_dir), ["o_orderkey"], "seq"))
    return replica_diff(o, replica, ["o_orderkey"], tol=0.01)
