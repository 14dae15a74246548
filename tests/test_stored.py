"""Stored models, pointers and bucketed tables."""

import os
import re
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from strata.operators import ml
from strata.operators.saved import fit_or_load, load_models
from strata.session import checkpoint_dir
from strata.sources.buckets import bucketed_once
from strata.sources.versions import built_once, read_pointer, version_of
from tests.conftest import SMOKE
from tests.helpers import rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SECOND = """
import json, sys
sys.path.insert(0, {root!r})
from strata.session import get_session
from strata.operators.saved import load_models
spark = get_session("local[2]", 2, extra={{"spark.checkpoint.dir": {base!r}}})
m = load_models(spark, "flag", "v1", {base!r}).model()
df = spark.read.parquet({data!r})
out = m.transform(df).selectExpr("id", "prediction", "probability").collect()
print("ROWS" + json.dumps(sorted([r.id, r.prediction, [float(x) for x in r.probability]] for r in out)))
"""


def _flagged(spark):
    return spark.range(400).select(
        "id", (F.col("id") % 37).cast("double").alias("x"),
        F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 < 3, "b").otherwise("c").alias("g"),
        ((F.col("id") % 37 > 18) | (F.col("id") % 5 == 0)).cast("int").alias("y"))


def test_second_session_scores_without_training(spark, tmp_path):
    import json

    base, data = f"{tmp_path}/models", f"{tmp_path}/data"
    _flagged(spark).write.parquet(data)
    df, trained = spark.read.parquet(data), []

    def fits(depth):
        def fit():
            trained.append(depth)
            return ml.train_rf(df, "y", ["x"], ["g"], trees=5, max_depth=depth)
        return fit

    def run():
        return fit_or_load(spark, "flag", "v1", {"shallow": fits(1), "deep": fits(6)},
                           lambda m, n: ml.evaluate_binary(m.transform(df), "y", model_name=n), "auc", base=base)

    first = run()
    assert trained == [1, 6] and first.champion == "deep"
    assert run() == first and trained == [1, 6]  # the stored version is not trained again
    assert {r.model for r in first.metrics().collect()} == {"shallow", "deep"}
    here = sorted([r.id, r.prediction, [float(x) for x in r.probability]]
                  for r in first.model().transform(df).select("id", "prediction", "probability").collect())
    other = subprocess.run([sys.executable, "-c", SECOND.format(root=ROOT, base=base, data=data)],
                           capture_output=True, text=True, timeout=240, check=True)
    assert json.loads(other.stdout.split("ROWS")[1]) == here
    with pytest.raises(KeyError):
        load_models(spark, "flag", "v2", base)
    with pytest.raises(KeyError):
        first.model("other")


def test_unfinished_build_is_not_read(spark, tmp_path):
    folder = f"{tmp_path}/thing"

    def dies(at):
        spark.range(3).write.parquet(f"{at}/t")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        built_once(spark, folder, dies)
    assert read_pointer(spark, folder) is None
    got = built_once(spark, folder, lambda at: spark.range(5).write.parquet(f"{at}/t"))
    assert spark.read.parquet(f"{got['at']}/t").count() == 5
    assert built_once(spark, folder, dies) == got


def test_version_follows_files_and_settings(spark, tmp_path):
    p = f"{tmp_path}/t"
    spark.range(3).write.parquet(p)
    v = version_of(spark, [p], "a")
    assert v == version_of(spark, [p], "a") and v != version_of(spark, [p], "b")
    spark.range(1).write.mode("append").parquet(p)
    assert v != version_of(spark, [p], "a")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_and_sum_do_not_shuffle(spark):
    from strata.plans.stored_q import order_margin_bucketed

    df = order_margin_bucketed(spark, SMOKE)
    plan = _plan(df)
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    assert "Bucketed: true" in plan


def test_hot_bucket_is_read_as_files_and_gives_the_same_rows(spark):
    base = f"{checkpoint_dir(spark)}/hot-{uuid.uuid4().hex}"
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("v"), F.lit(None).cast("string").alias("s"))
    for skew_bytes, bucketed in ((0, False), (1 << 40, True)):
        got = bucketed_once(spark, f"hot{skew_bytes}", "v", lambda: df, ["k"], 16, base, skew_bytes)
        assert rows(got) == rows(df) and got.dtypes == df.dtypes
        joined = got.hint("merge").join(got.select("k", F.lit(1).alias("one")).distinct(), "k")
        assert joined.count() == 6000
        assert ("Bucketed: true" in _plan(joined)) is bucketed
    files = got.inputFiles()
    assert len(files) > 16  # the hot bucket was written by several tasks
    even = bucketed_once(spark, "even", "v", lambda: spark.range(1000).toDF("k"), ["k"], 8, base, 0)
    assert "Bucketed: true" in _plan(even.groupBy("k").count())
    assert "Exchange" not in _plan(even.groupBy("k").count())


def test_bucketed_empty_table_and_null_keys(spark):
    base = f"{checkpoint_dir(spark)}/odd-{uuid.uuid4().hex}"
    none = bucketed_once(spark, "none", "v", lambda: spark.createDataFrame([], "k int, v string"), ["k"], 8, base)
    assert none.collect() == [] and none.columns == ["k", "v"]
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (1, None), (1, None)], "k int, v string")
    assert rows(bucketed_once(spark, "odd", "v", lambda: odd, ["k"], 8, base)) == rows(odd)


def test_each_bucket_is_written_by_a_task_of_its_own(spark):
    base = f"{checkpoint_dir(spark)}/own-{uuid.uuid4().hex}"
    got = bucketed_once(spark, "own", "v", lambda: spark.range(4000).toDF("k"), ["k"], 32, base)
    tasks = [f.rsplit("/", 1)[-1].split("-")[1] for f in got.inputFiles()]
    assert len(tasks) == len(set(tasks)) == 32  # file names begin with the number of the task


def test_kept_rows_are_computed_once(spark):
    """Every pass of two fits reads the kept rows, not the plan that made them; afterwards they are let go."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _flagged(spark)
    df = df.mapInArrow(count, df.schema)
    with ml.kept(df):
        ml.train_rf(df, "y", ["x"], ["g"], trees=3, max_depth=3)
        ml.train_gbt(df, "y", ["x"], ["g"], max_iter=2, max_depth=2)
        assert seen.value == 400
    assert not df.storageLevel.useMemory and not df.storageLevel.useDisk


@pytest.mark.parametrize("query", ["ml_model_metrics", "ml_demand_regression"])
def test_models_train_on_kept_rows(spark, monkeypatch, tmp_path, query):
    """Both models of a query train on rows that are kept until then, and a stored run keeps none."""
    from strata.plans import ml_q

    fitted = []
    for name, small in (("train_rf", {"trees": 2, "max_depth": 2}), ("train_gbt", {"max_iter": 2, "max_depth": 2})):
        def fit(t, *a, _f=getattr(ml, name), _s=small, **k):
            fitted.append((t, t.storageLevel.useMemory))
            return _f(t, *a, **{**k, **_s})
        monkeypatch.setattr(ml, name, fit)
    data = f"{tmp_path}/data"
    for t in ("orders", "lineitem", "customer", "nation"):
        spark.read.parquet(f"{SMOKE}/{t}.parquet").limit(600).write.parquet(f"{data}/{t}.parquet")
    for _ in range(2):  # the second time from the stored models
        getattr(ml_q, query)(spark, data).collect()
        assert [kept for _, kept in fitted] == [True, True]
        assert not any(t.storageLevel.useMemory for t, _ in fitted)


def test_forest_with_kept_node_ids_is_the_same_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier

    df = _flagged(spark).repartition(3, "id").cache()
    ours = ml.train_rf(df, "y", ["x"], ["g"], trees=7, max_depth=6).stages[-1]
    assert ours.getCacheNodeIds()
    plain = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=7, maxDepth=6, seed=42, maxBins=64)
    other = ml._pipeline(["x"], ["g"], plain).fit(df).stages[-1]
    assert ours.toDebugString.split("\n", 1)[1] == other.toDebugString.split("\n", 1)[1]
    df.unpersist()


# ------------------------------------------------------------------ trees on blocks of rows
def _mixed(spark, n=1500):
    """Rows with continuous, small and categorical features, nulls among the categories, in three partitions."""
    df = spark.range(n).select(
        "id", F.rand(1).alias("x"), F.floor(F.rand(5) * 50).alias("q"), F.floor(F.rand(11) * 7).alias("w"), F.lit(3.0).alias("same"),
        F.when(F.rand(3) < 0.9, F.floor(F.rand(3) * 5).cast("string")).alias("g"), F.floor(F.rand(4) * 7).cast("string").alias("h"))
    return df.withColumns({"y": ((F.col("x") + F.col("q") / 50 + F.rand(7)) > 1.4).cast("int"),
                           "t": F.floor(F.col("q") * F.col("x") + F.rand(8) * 10).cast("double")}).repartition(3, "id").cache()


MIXED = ["x", "q", "w", "same"], ["g", "h"]


@pytest.mark.parametrize("kind, settings", [
    ("RandomForestClassifier", {"numTrees": 37, "maxDepth": 7}),
    ("RandomForestClassifier", {"numTrees": 6, "maxDepth": 9, "maxMemoryInMB": 1}),  # a level takes several passes
    ("RandomForestClassifier", {"numTrees": 1, "maxDepth": 4}),
    ("RandomForestClassifier", {"numTrees": 5, "maxDepth": 4, "bootstrap": False}),
    ("RandomForestRegressor", {"numTrees": 33, "maxDepth": 6}),
    ("GBTRegressor", {"maxIter": 4, "maxDepth": 5, "stepSize": 0.07}),
    ("GBTClassifier", {"maxIter": 4, "maxDepth": 5, "stepSize": 0.07}),
])
def test_trees_on_blocks_are_spark_mls_trees(spark, monkeypatch, kind, settings):
    """Whole models, node by node; with blocks of few rows."""
    from pyspark.ml import classification, regression

    from strata.operators import trees

    monkeypatch.setattr(trees, "BLOCK", 200)
    df = _mixed(spark)
    label = "y" if kind.endswith("Classifier") else "t"
    est = getattr(classification if label == "y" else regression, kind)(
        labelCol=label, featuresCol="features", seed=42, maxBins=64, **settings)
    plain = ml._pipeline(*MIXED, est).fit(df)
    data = df
    for stage in plain.stages[:-1]:
        data = stage.transform(data)
    assert trees._rules(est, data, 1, "all", kind.startswith("GBT"), label == "y") is not None
    ours, spark_ml = trees.fit(est, data), plain.stages[-1]

    def shape(model):  # numbers to 10 digits: sums of fractions depend on the order of rows
        return re.sub(r"\d+\.\d+(E-?\d+)?", lambda m: f"{float(m[0]):.10g}", model.toDebugString.split("\n", 1)[1])

    assert shape(ours) == shape(spark_ml)
    assert ours.treeWeights == spark_ml.treeWeights
    assert abs(ours.featureImportances.toArray() - spark_ml.featureImportances.toArray()).max() < 1e-9
    a, b = (m.transform(data).select("id", "prediction").orderBy("id").toPandas() for m in (ours, spark_ml))
    assert (abs(a.prediction - b.prediction) < 1e-9).all()
    df.unpersist()


@pytest.mark.parametrize("fit, spark_ml", [("train_rf", "RandomForestClassifier"), ("train_gbt", "GBTClassifier")])
def test_training_walks_over_blocks(spark, monkeypatch, fit, spark_ml):
    """Neither trainer goes over the rows in Spark ML's own way, one object and one node id per row and tree."""
    from pyspark.ml import classification

    def fail(self, *a):
        raise AssertionError("trained row by row")

    monkeypatch.setattr(getattr(classification, spark_ml), "_fit", fail)
    small = {"trees": 3} if fit == "train_rf" else {"max_iter": 2}
    df = _mixed(spark, 300)
    model = getattr(ml, fit)(df, "y", *MIXED, max_depth=3, **small)
    assert model.transform(df).filter("prediction in (0.0, 1.0)").count() == 300
    df.unpersist()


def test_several_classes_are_left_to_spark_ml(spark):
    df = _mixed(spark, 300).withColumn("y", F.col("id") % 3)
    model = ml.train_rf(df, "y", *MIXED, trees=3, max_depth=3)
    assert model.stages[-1].numClasses == 3


def test_demand_regression_scores_held_out_rows_once_for_its_aggregates(spark, monkeypatch, tmp_path):
    from strata.plans import ml_q

    for name, small in (("train_rf", {"trees": 2, "max_depth": 2}), ("train_gbt", {"max_iter": 2, "max_depth": 2})):
        monkeypatch.setattr(ml, name, lambda t, *a, _f=getattr(ml, name), _s=small, **k: _f(t, *a, **{**k, **_s}))
    spark.read.parquet(f"{SMOKE}/lineitem.parquet").limit(600).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = ml_q.ml_demand_regression(spark, str(tmp_path))
    row = out.first()
    assert row.high_demand_rows + row.low_demand_rows + row.stable_rows == row.n
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"UDF\(features#\d+\) AS prediction#\d+", plan))) <= 1
    assert "Subquery" not in plan
