"""Queries on changing tables: publication, replica, quarantine, running statistics.

Each reads a whole shared table, lands it in pieces in the scratch folder and
runs the real mechanism over them: several versions, change batches or
micro-batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.catalog import query, table
from strata.plans.stream_q import SQL_ORDER_CHANGES, order_changes
from strata.streaming import _scratch, read_stream, run_to_completion


# ------------------------------------------------------------------ S5 / S11
@query("orders_published_refresh", "S5 S11 S4", """
SELECT *, o_totalprice > 150000 AS big FROM orders
""")
def orders_published_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, compacted, refreshed with one more column; read by name after each switch."""
    from strata.sources import read_table
    from strata.sources.publish import compact_published, expire, publish

    base, name = _scratch(spark, "published-orders"), f"orders_published_{uuid.uuid4().hex[:12]}"
    publish(table(spark, sf_dir, "orders"), name, base)
    compact_published(spark, name, base, sort_cols=["o_orderdate"])
    wider = read_table(spark, name).withColumn("big", F.col("o_totalprice") > 150000)
    publish(wider, name, base)
    expire(spark, name, keep=2)
    return read_table(spark, name)


# ------------------------------------------------------------------ T10
@query("orders_incremental_replica", "T10", SQL_ORDER_CHANGES + """
SELECT * EXCLUDE (change) FROM applied WHERE change <> 'deleted'
""")
def orders_incremental_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of changes as batches of their own, one of them delivered twice."""
    from strata.streaming.replica import apply_batch, create_replica, read_replica

    path, width = _scratch(spark, "replica-orders"), 1 << 20
    create_replica(table(spark, sf_dir, "orders"), path, "o_orderkey", width)
    changes = order_changes(spark, sf_dir)
    for batch in (1, 2, 2, 3):
        apply_batch(spark, path, changes.where(F.col("seq") == batch), "o_orderkey", width, "seq", batch)
    return read_replica(spark, path)


# ------------------------------------------------------------------ T2 / S17 / S21
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _event_lines(spark: SparkSession, sf_dir: str) -> str:
    """All events landed as JSON lines, some of them damaged in three ways."""
    path, e = _scratch(spark, "landing-events-json"), table(spark, sf_dir, "events")
    whole = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value"))
    typed = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type",
                               F.concat(F.lit("n/a "), F.col("value").cast("string")).alias("value")))
    lacking = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = (F.when(F.col("event_id") % 97 == 0, F.expr("left(w, length(w) - 9)"))
            .when(F.col("event_id") % 89 == 0, F.col("t")).when(F.col("event_id") % 83 == 0, F.col("l")).otherwise(F.col("w")))
    e.select("event_id", whole.alias("w"), typed.alias("t"), lacking.alias("l")).select(line.alias("value")).repartition(3).write.text(path)
    return path


SQL_QUARANTINE = """
WITH r AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN event_id % 89 = 0 THEN 'type:value'
                          WHEN event_id % 83 = 0 THEN 'missing:ts' END AS reason FROM events)
SELECT coalesce(reason, 'good') AS outcome, CASE WHEN reason IS NULL THEN event_type END AS event_type, count(*) AS n,
       sum(CASE WHEN reason IS NULL THEN CAST(round(value * 100.0) AS BIGINT) END)::BIGINT AS value_units,
       max(CASE WHEN reason IS NULL THEN ts END)::TIMESTAMP AS last_ts
FROM r GROUP BY 1, 2
"""


def _outcomes(good: DataFrame, rejected: DataFrame) -> DataFrame:
    from strata.functions import units

    g = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(units("value", 2)).cast("long").alias("value_units"),
                                       F.max("ts").alias("last_ts")).withColumn("outcome", F.lit("good"))
    r = rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return g.unionByName(r, allowMissingColumns=True).select("outcome", "event_type", "n", "value_units", "last_ts")


@query("event_ingest_quarantine", "T2 S17 S21", SQL_QUARANTINE)
def event_ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.sources.quarantine import parse_lines, split_rows

    return _outcomes(*split_rows(parse_lines(spark.read.text(_event_lines(spark, sf_dir)), EVENT_SCHEMA, required=["event_id", "ts"])))


@query("stream_event_ingest_quarantine", "T2 S17 T1", SQL_QUARANTINE)
def stream_event_ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.sources.quarantine import quarantine_stream, read_quarantine

    sink = _scratch(spark, "quarantine-events")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(_event_lines(spark, sf_dir))
    run_to_completion(quarantine_stream(lines, EVENT_SCHEMA, sink, required=["event_id", "ts"]))
    return _outcomes(*read_quarantine(spark, sink))


# ------------------------------------------------------------------ T5 / T6 as streams
def _events_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several micro-batches, one landed file each."""
    path, e = _scratch(spark, "landing-events"), table(spark, sf_dir, "events")
    e.repartition(3, "event_id").write.parquet(path)
    return read_stream(spark, path, e.schema, max_files=1)


@query("stream_signal_by_user_top20", "T5", """
SELECT user_id, CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value)
         AS avg_value, max(value) AS max_value
FROM events GROUP BY user_id ORDER BY avg_value DESC, user_id LIMIT 20
""")
def stream_signal_by_user_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.streaming.running import read_newest, top_groups_stream

    sink = _scratch(spark, "sink-top20")
    run_to_completion(top_groups_stream(_events_in_files(spark, sf_dir), "user_id", "value", sink, _scratch(spark, "ckpt-top20")))
    return read_newest(spark, sink)


@query("stream_three_sigma_outliers", "T6 T9", """
WITH st AS (SELECT user_id, CAST(sum(CAST(round(value * 100.0) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count(value) AS avg_val,
                   stddev_samp(value) AS stdev_val FROM events GROUP BY user_id)
SELECT e.user_id, e.value, round(st.avg_val, 6) AS avg_val, round(st.stdev_val, 6) AS stdev_val
FROM events e JOIN st USING (user_id) WHERE e.value > st.avg_val + 3 * st.stdev_val
""")
def stream_three_sigma_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.streaming import read_alerts
    from strata.streaming.running import moments_stream, sigma_stream

    events = _events_in_files(spark, sf_dir)
    parts, sink = _scratch(spark, "moments"), _scratch(spark, "sink-sigma")
    run_to_completion(moments_stream(events, "user_id", "value", parts, _scratch(spark, "ckpt-moments"), scale=2))
    run_to_completion(sigma_stream(events, parts, "user_id", "value", sink, _scratch(spark, "ckpt-sigma")))
    out = read_alerts(spark, sink)
    return out.withColumns({"avg_val": F.round("avg_val", 6), "stdev_val": F.round("stdev_val", 6)})
