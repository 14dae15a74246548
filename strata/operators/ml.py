"""Model lifecycle on Spark ML.

Training, evaluation and scoring stay distributed: features are built with
DataFrame operators, models are Spark ML ``Pipeline``s (indexers →
assembler → tree ensemble), metrics are single aggregates over the scored
table, and batch scoring is ``PipelineModel.transform`` — no rows are
collected to the driver (the reference converts whole tables to pandas).
Only model metadata (feature importances, a handful of metric rows) is
small enough to build on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import band, positive_probability
from strata.operators.aggregates import kpi


# ------------------------------------------------------------------ features
def entity_day_features(df: DataFrame, entity: str, ts: str, cols: Sequence[str],
                        flags: Mapping[str, Column] | None = None, digits: int = 4,
                        scale: int | None = None) -> DataFrame:
    """M3: per entity and day — count, mean, stddev, min, max, range per
    signal, and counts of flagged rows.  ``scale`` (decimals carried by the
    signals) switches the mean to the exact, order-independent form."""
    from strata.functions import exact_avg

    aggs: dict[str, Column] = {"reading_count": F.count(F.lit(1))}
    for c in cols:
        aggs[f"avg_{c}"] = exact_avg(c, scale) if scale is not None else F.round(F.avg(c), digits)
        aggs[f"std_{c}"] = F.round(F.coalesce(F.stddev(c), F.lit(0.0)), digits)
        aggs[f"min_{c}"] = F.min(c)
        aggs[f"max_{c}"] = F.max(c)
    for name, pred in (flags or {}).items():
        aggs[name] = F.count_if(F.coalesce(pred, F.lit(False)))
    out = kpi(df.withColumn("day", F.to_date(F.col(ts))), [entity, "day"], aggs)
    return out.withColumns({f"range_{c}": F.round(F.col(f"max_{c}") - F.col(f"min_{c}"), digits) for c in cols})


def feature_table(fact: DataFrame, dims: Sequence[tuple], label: Column | str, label_name: str,
                  exclude: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """M5: row-level features from a star join, minus leakage columns, with
    the label attached and NULLs filled (numeric → 0, categorical → 'unknown')."""
    from strata.operators.joins import star
    from strata.operators.quality import fill_features

    f = star(fact, dims)
    lab = F.col(label) if isinstance(label, str) else label
    f = f.withColumn(label_name, lab.cast("int")).drop(*exclude)
    return fill_features(f, categorical=list(categorical))


def demand_features(lines: DataFrame, product: str, date_col: str, qty: str, price: str,
                    cost: str | None = None, lags: Sequence[int] = (1, 7), scale: int | None = None) -> DataFrame:
    """M6: daily quantity per product with calendar features, lags and margin.

    ``scale`` (decimals of price/cost) gives exact, order-independent means."""
    from strata.functions import exact_avg
    from strata.operators.windows import lag_features

    def mean(c):
        return exact_avg(c, scale) if scale is not None else F.round(F.avg(c), 4)

    d = F.to_date(F.col(date_col))
    aggs = {"daily_quantity": F.sum(qty), "avg_price": mean(price), "lines": F.count(F.lit(1))}
    if cost:
        aggs["avg_cost"] = mean(cost)
    daily = kpi(lines.withColumn("txn_date", d), [product, "txn_date"], aggs)
    daily = daily.withColumns({
        "day_of_week": F.dayofweek("txn_date"), "day_of_month": F.dayofmonth("txn_date"),
        "month": F.month("txn_date"), "is_weekend": F.dayofweek("txn_date").isin(1, 7).cast("int"),
    })
    if cost:
        daily = daily.withColumn("price_margin", F.col("avg_price") - F.col("avg_cost"))
    return lag_features(daily, [product], "txn_date", {"daily_quantity": list(lags)})


# ------------------------------------------------------------------ encoding / split
def fit_ordinal_map(df: DataFrame, c: str) -> DataFrame:
    """M7 fit: ``(value, index)`` for the sorted distinct values of ``c``.

    The mapping is a DataFrame built by the distributed dense rank, so a
    high-cardinality column never passes through the driver (unlike an
    indexer whose label array is collected).  Persist it (write a table) to
    reuse the same encoding at scoring time.
    """
    from strata.operators.windows import ranked

    vals = df.select(F.col(c).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return ranked(vals, ["value"], (), False, "dense_rank", "__r").select(
        "value", (F.col("__r") - 1).cast("int").alias("index"))


def ordinal_encode(df: DataFrame, cats: Sequence[str], maps: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """M7: ``{c}_idx`` = position of the value among the sorted distinct
    values; unseen (or NULL) values → −1.  Pass the fitted ``maps`` (from
    ``fit_ordinal_map``) at scoring time; by default they are fitted on ``df``."""
    out = df
    for c in cats:
        m = (maps or {}).get(c)
        m = m if m is not None else fit_ordinal_map(df, c)
        m = m.select(F.col("value").alias(f"__v_{c}"), F.col("index").alias(f"{c}_idx"))
        out = out.join(m, out[c] == m[f"__v_{c}"], "left").drop(f"__v_{c}")
        out = out.withColumn(f"{c}_idx", F.coalesce(F.col(f"{c}_idx"), F.lit(-1)))
    return out


def split_flag(df: DataFrame, key: Sequence[str] | str, train_pct: int = 80, seed: int = 42,
               name: str = "is_train") -> DataFrame:
    """M8: deterministic train/test split by hashing the row key — the same
    rows land in the same split regardless of partitioning or re-runs."""
    keys = [key] if isinstance(key, str) else list(key)
    h = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(100))
    return df.withColumn(name, h < F.lit(train_pct))


# ------------------------------------------------------------------ training
@contextmanager
def kept(*frames: DataFrame):
    """Rows that are computed once while models are trained and measured on them, and let go afterwards.

    Every step before the trees (categories, bins, metrics) and the trees themselves read these rows again; from the
    feature query each would repeat its joins.  They stay in the partitions that the query made, by which the forest's
    row samples and the bins are drawn.  Nothing is computed where nothing is trained."""
    conf, key = frames[0].sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(key, None)
    conf.set(key, "true")  # or kept rows would have one partition for each of spark.sql.shuffle.partitions
    for f in frames:
        f.persist(StorageLevel.MEMORY_AND_DISK)
    conf.unset(key) if before is None else conf.set(key, before)
    try:
        yield
    finally:
        for f in frames:
            f.unpersist()


def _fitted(numeric: Sequence[str], categorical: Sequence[str], estimator, train: DataFrame):
    """The pipeline fitted on ``train``; its trees are grown on binned blocks of rows (``trees.fit``)."""
    from pyspark.ml import Pipeline, PipelineModel

    from strata.operators import trees

    prepared = Pipeline(stages=_pipeline(numeric, categorical, estimator).getStages()[:-1]).fit(train)
    return PipelineModel([*prepared.stages, trees.fit(estimator, prepared.transform(train))])


def _pipeline(numeric: Sequence[str], categorical: Sequence[str], estimator):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    # categorical features must have bounded cardinality: each indexer's
    # label array (one entry per distinct value) is part of the fitted model
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in categorical]
    vec = VectorAssembler(inputCols=list(numeric) + [f"{c}__idx" for c in categorical],
                          outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*idx, vec, estimator])


def max_bins(train: DataFrame, categorical: Sequence[str], least: int = 64) -> int:
    """Bins that hold every category of every column, and one for unseen ones."""
    if not categorical:
        return least
    n = train.agg(*[F.countDistinct(c).alias(c) for c in categorical]).first()
    return max(least, *(v + 2 for v in n))


def train_gbt(train: DataFrame, label: str, numeric, categorical=(), max_iter: int = 100, max_depth: int = 10,
              step: float = 0.07, seed: int = 42, regression: bool = False):
    """Gradient-boosted trees (classifier or regressor)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    cls = GBTRegressor if regression else GBTClassifier
    est = cls(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth, stepSize=step,
              seed=seed, maxBins=max_bins(train, categorical))
    return _fitted(numeric, categorical, est, train)


def train_rf(train: DataFrame, label: str, numeric, categorical=(), trees: int = 120, max_depth: int = 10,
             seed: int = 42, regression: bool = False):
    """Random forest (classifier or regressor)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    cls = RandomForestRegressor if regression else RandomForestClassifier
    # each row's node in each tree is kept, or every level would walk all trees from their roots for every row; a level is
    # one step of that lineage, so it is cut only in far deeper trees
    est = cls(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=max_depth, seed=seed,
              maxBins=max_bins(train, categorical), cacheNodeIds=True, checkpointInterval=30)
    return _fitted(numeric, categorical, est, train)


# ------------------------------------------------------------------ evaluation
def evaluate_binary(pred: DataFrame, label: str, prediction: str = "prediction",
                    probability: str = "probability", model_name: str | None = None) -> DataFrame:
    """AUC (rank statistic, distributed) + accuracy, precision, recall, F1
    from one aggregate of the confusion counts."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    p = pred.withColumn("__p1", positive_probability(probability))
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="__p1",
                                        metricName="areaUnderROC", numBins=0).evaluate(p)
    y, yhat = F.col(label).cast("int"), F.col(prediction).cast("int")
    m = pred.agg(F.count_if((y == 1) & (yhat == 1)).alias("tp"), F.count_if((y == 0) & (yhat == 1)).alias("fp"),
                 F.count_if((y == 1) & (yhat == 0)).alias("fn"), F.count_if((y == 0) & (yhat == 0)).alias("tn"))
    prec = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    rec = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    out = m.withColumns({
        "auc": F.round(F.lit(float(auc)), 4),
        "accuracy": F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 4),
        "precision": F.round(F.coalesce(prec, F.lit(0.0)), 4),
        "recall": F.round(F.coalesce(rec, F.lit(0.0)), 4),
    }).withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                        F.col("precision") + F.col("recall")), F.lit(0.0)), 4))
    return out.withColumn("model", F.lit(model_name)) if model_name else out


def evaluate_regression(pred: DataFrame, label: str, prediction: str = "prediction",
                        model_name: str | None = None, digits: int = 4) -> DataFrame:
    """RMSE, MAE, R² in one aggregate pass (SST from the label's variance)."""
    y, yhat = F.col(label).cast("double"), F.col(prediction).cast("double")
    m = pred.agg(F.count(F.lit(1)).alias("n"), F.sum((y - yhat) ** 2).alias("__sse"),
                 F.sum(F.abs(y - yhat)).alias("__sae"), F.var_pop(y).alias("__var"))
    m = m.withColumn("__sst", F.col("__var") * F.col("n"))
    out = m.select("n",
                   F.round(F.sqrt(F.col("__sse") / F.col("n")), digits).alias("rmse"),
                   F.round(F.col("__sae") / F.col("n"), digits).alias("mae"),
                   F.round(F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("__sst")), digits).alias("r2"))
    return out.withColumn("model", F.lit(model_name)) if model_name else out


def pick_champion(metrics: DataFrame, metric: str, higher_is_better: bool = True, name_col: str = "model",
                  tie_break: str | None = None) -> DataFrame:
    """Champion row by the metric (≥ for AUC-like, ≤ for error-like);
    ties go to the earlier-listed model name."""
    m = F.col(metric)
    order = F.struct(-m if higher_is_better else m, F.col(tie_break or name_col))
    return metrics.agg(F.min_by(F.struct(*[F.col(c) for c in metrics.columns]), order).alias("c")).select("c.*")


def confusion(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Confusion counts ``(label, prediction, n)``."""
    return (pred.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_report(pred: DataFrame, label: str, prediction: str = "prediction", digits: int = 4) -> DataFrame:
    """Per-class precision / recall / F1 / support from the confusion counts."""
    c = confusion(pred, label, prediction)
    tp = c.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    pred_n = c.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("pred_n"))
    sup = c.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    r = sup.join(pred_n, "cls", "full_outer").join(tp, "cls", "left").na.fill(0, ["tp", "pred_n", "support"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    r = r.withColumns({"precision": F.round(prec, digits), "recall": F.round(rec, digits)})
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return r.withColumn("f1", F.round(f1, digits)).select("cls", "support", "precision", "recall", "f1")


def importance(spark, model, names: Sequence[str]) -> DataFrame:
    """Normalised feature importances, largest first (a few rows — the
    model's own metadata, built on the driver)."""
    est = model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    total = sum(imp) or 1.0
    rows = [(n, float(v), float(v) / total) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double, importance_norm double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def residuals(pred: DataFrame, label: str, prediction: str = "prediction", digits: int = 4,
              extras: Mapping[str, Column] | None = None) -> DataFrame:
    """Residual profile and MAPE on non-zero actuals, one aggregate;
    ``extras`` are further aggregates of the same pass."""
    y, yhat = F.col(label).cast("double"), F.col(prediction).cast("double")
    r = y - yhat
    return pred.agg(
        F.round(F.avg(r), digits).alias("mean_residual"),
        F.round(F.stddev(r), digits).alias("std_residual"),
        F.round(F.min(r), digits).alias("min_residual"),
        F.round(F.max(r), digits).alias("max_residual"),
        F.round(F.avg(F.when(y != 0, F.abs(r) / F.abs(y))) * F.lit(100.0), digits).alias("mape_pct"),
        *[c.alias(n) for n, c in (extras or {}).items()],
    )


# ------------------------------------------------------------------ scoring
# Probability bands for risk levels, as published.
RISK_BANDS = [(">", 0.8, "critical"), (">", 0.6, "high"), (">", 0.4, "medium")]
SUMMARY_BANDS = [(">", 0.6, "high"), (">", 0.3, "medium")]


def score(model, df: DataFrame, label_name: str = "predicted", prob_name: str = "probability_positive",
          bands=RISK_BANDS, default: str = "low") -> DataFrame:
    """Batch score — rounded positive probability, predicted class, band."""
    p = model.transform(df)
    p = p.withColumns({prob_name: F.round(positive_probability("probability"), 4),
                       label_name: F.col("prediction").cast("int")})
    return p.withColumn("risk_level", band(prob_name, bands, default)).drop(
        "features", "rawPrediction", "probability", "prediction",
        *[c for c in p.columns if c.endswith("__idx")])


def risk_band_of(prob: Column | str, bands=RISK_BANDS, default: str = "low") -> Column:
    return band(prob, bands, default)


def demand_signal(pred: Column | str, actual: Column | str, up: float = 1.3, down: float = 0.7) -> Column:
    """M19: 'high_demand' above +30 % of actual, 'low_demand' below −30 %."""
    p = F.col(pred) if isinstance(pred, str) else pred
    a = F.col(actual) if isinstance(actual, str) else actual
    return (F.when(p > a * F.lit(up), F.lit("high_demand"))
            .when(p < a * F.lit(down), F.lit("low_demand")).otherwise(F.lit("stable")))


def risk_summary(scored: DataFrame, keys: Sequence[str], prob: str, predicted: str, actual: str,
                 extras: Mapping[str, Column] | None = None, bands=SUMMARY_BANDS,
                 digits: int = 4) -> DataFrame:
    """Per-segment predicted/actual counts, mean probability, predicted
    rate and an overall risk band."""
    aggs = {"total": F.count(F.lit(1)), "predicted_count": F.sum(F.col(predicted).cast("long")),
            "actual_count": F.sum(F.col(actual).cast("long")),
            "avg_probability": F.round(F.avg(prob), digits)}
    aggs.update(extras or {})
    s = kpi(scored, keys, aggs)
    s = s.withColumn("predicted_rate", F.round(F.col("predicted_count") / F.col("total") * F.lit(100.0), 1))
    return s.withColumn("overall_risk", band("avg_probability", bands, "low"))
