"""Evaluation and scoring queries on a deterministic scored table (M12–M15,
M17, M18, M20, D12).

The "model" is a fixed formula over the order key, so metrics, bands and
summaries have SQL oracles; what trained models give is checked elsewhere.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import ml
from strata.plans.catalog import query, table

PRIME = 10007  # residues of the key give probabilities and labels


class Formula:
    """A model's ``transform``: probability vector and class from the key."""

    def __init__(self, factor: int):
        self.factor = factor

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.pmod(F.col("o_orderkey") * self.factor, F.lit(PRIME)) / F.lit(float(PRIME))
        return df.withColumns({"probability": array_to_vector(F.array(1 - p, p)),
                               "prediction": F.when(p > 0.5, 1.0).otherwise(0.0)})


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label that the first formula's probability explains in part."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    p, q = (F.pmod(F.col("o_orderkey") * k, F.lit(PRIME)) for k in (7919, 104729))
    return o.withColumn("y", (q < p).cast("int"))


SQL_SCORED = f"""
WITH s AS (SELECT o_orderkey, o_orderpriority, o_totalprice,
    CAST((o_orderkey * 104729) % {PRIME} < (o_orderkey * 7919) % {PRIME} AS INT) AS y,
    CAST((o_orderkey * 7919) % {PRIME} AS DOUBLE) / {PRIME}.0::DOUBLE AS p1,
    CAST((o_orderkey * 15485863) % {PRIME} AS DOUBLE) / {PRIME}.0::DOUBLE AS p2 FROM orders),
m AS (SELECT 'first' AS model, p1 AS p, CAST(p1 > 0.5 AS INT) AS yhat, * FROM s
      UNION ALL SELECT 'second', p2, CAST(p2 > 0.5 AS INT), * FROM s)
"""


def _models() -> dict[str, Formula]:
    return {"first": Formula(7919), "second": Formula(15485863)}


@query("scored_binary_metrics", "M12 M14 D12", SQL_SCORED + """
, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rk FROM m),
c AS (SELECT model, count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp, count_if(y = 1 AND yhat = 0) AS fn,
             count_if(y = 0 AND yhat = 0) AS tn,
             (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * count_if(y = 0)) AS auc FROM r GROUP BY model),
t AS (SELECT model, tp, fp, fn, tn, round(auc, 4) AS auc, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
             round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c)
SELECT *, round(2 * precision * recall / (precision + recall), 4) AS f1, auc = max(auc) OVER () AS is_champion FROM t
""")
def scored_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, out = labelled_orders(spark, sf_dir), None
    for name, model in _models().items():
        e = ml.evaluate_binary(model.transform(o), "y", model_name=name)
        out = e if out is None else out.unionByName(e)
    best = ml.pick_champion(out, "auc").select(F.col("model").alias("best"))  # one row
    return out.join(F.broadcast(best), F.col("model") == F.col("best"), "left").withColumn(
        "is_champion", F.col("best").isNotNull()).drop("best")


@query("scored_class_report", "M15", SQL_SCORED + """
, k AS (SELECT unnest([0, 1]) AS cls),
c AS (SELECT cls, count_if(y = cls) AS support, count_if(yhat = cls) AS n, count_if(y = cls AND yhat = cls) AS tp
      FROM m, k WHERE model = 'first' GROUP BY cls)
SELECT cls, support, round(tp / n, 4) AS precision, round(tp / support, 4) AS recall,
       round(2 * (tp / n) * (tp / support) / (tp / n + tp / support), 4) AS f1 FROM c
""")
def scored_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.class_report(Formula(7919).transform(labelled_orders(spark, sf_dir)), "y")


@query("scored_risk_levels", "M18 U1 P10", SQL_SCORED + """
SELECT o_orderkey, y, yhat AS predicted, round(p, 4) AS probability_positive,
       CASE WHEN round(p, 4) > 0.8 THEN 'critical' WHEN round(p, 4) > 0.6 THEN 'high' WHEN round(p, 4) > 0.4 THEN 'medium'
            ELSE 'low' END AS risk_level FROM m WHERE model = 'first'
""")
def scored_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.score(Formula(7919), labelled_orders(spark, sf_dir)).drop("o_orderpriority", "o_totalprice")


@query("scored_risk_summary", "M20", SQL_SCORED + """
, g AS (SELECT o_orderpriority, count(*) AS total, sum(yhat) AS predicted_count, sum(y) AS actual_count,
               round(avg(round(p, 4)), 4) AS avg_probability, round(sum(yhat) / count(*) * 100, 1) AS predicted_rate
        FROM m WHERE model = 'first' GROUP BY 1)
SELECT o_orderpriority, total, CAST(predicted_count AS BIGINT) AS predicted_count, CAST(actual_count AS BIGINT) AS actual_count,
       avg_probability, predicted_rate, CASE WHEN avg_probability > 0.6 THEN 'high' WHEN avg_probability > 0.3 THEN 'medium'
       ELSE 'low' END AS overall_risk FROM g
""")
def scored_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ml.score(Formula(7919), labelled_orders(spark, sf_dir))
    return ml.risk_summary(scored, ["o_orderpriority"], "probability_positive", "predicted", "y")


@query("scored_residuals", "M13 M17", f"""
WITH s AS (SELECT CAST(o_orderkey % 97 AS DOUBLE) AS y, CAST((o_orderkey * 31) % 97 AS DOUBLE) AS yhat FROM orders)
SELECT count(*) AS n, round(sqrt(sum((y - yhat) ** 2) / count(*)), 4) AS rmse, round(sum(abs(y - yhat)) / count(*), 4) AS mae,
       round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(y - yhat), 4) AS mean_residual,
       round(stddev_samp(y - yhat), 4) AS std_residual, round(min(y - yhat), 4) AS min_residual, round(max(y - yhat), 4) AS max_residual,
       round(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / y END) * 100, 4) AS mape_pct FROM s
""")
def scored_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = o.select((F.col("o_orderkey") % 97).cast("double").alias("y"), (F.col("o_orderkey") * 31 % 97).cast("double").alias("prediction"))
    e, r = ml.evaluate_regression(p, "y"), ml.residuals(p, "y")
    return e.select("*", *[r.select(c).scalar().alias(c) for c in r.columns])
