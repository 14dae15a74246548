"""View builders of the packages on small frames."""

from pyspark.sql import functions as F

from strata.plans.packages import grouped, listing, mean_of_means


def test_grouped_totals_names_and_weights(spark):
    t = {"daily": spark.createDataFrame(
        [("a", 1, 2, 10.0), ("a", 1, 6, 2.0), ("a", 2, 0, None), (None, 1, 4, 3.0)], "k string, day int, n long, mean double")}
    rows = grouped("daily", "dept=k", "n", total=F.count(F.lit(1)), mean=mean_of_means("mean", "n"))(t)
    assert {r.dept: (r.n, r.total, r["mean"]) for r in rows.collect()} == {"a": (8, 3, 4.0), None: (4, 1, 3.0)}
    renamed = grouped("daily", "k day", "visits=n")(t)
    assert renamed.columns == ["k", "day", "visits"]
    assert {(r.k, r.day, r.visits) for r in renamed.collect()} == {("a", 1, 8), ("a", 2, 0), (None, 1, 4)}


def test_mean_of_means_without_rows_is_null(spark):
    t = {"daily": spark.createDataFrame([("a", 0, 5.0)], "k string, n long, mean double")}
    assert grouped("daily", "k", "", mean=mean_of_means("mean", "n"))(t).collect()[0]["mean"] is None
    assert grouped("daily", "k", "n")({"daily": t["daily"].limit(0)}).count() == 0


def test_listing_replaces_and_adds_columns(spark):
    t = {"card": spark.createDataFrame([("a", 1.234), ("b", 5.678)], "k string, v double")}
    rows = listing("card", "k v w", F.col("v") > 2, v=F.round("v", 1), w=F.col("v") * 2)(t)
    assert [tuple(r) for r in rows.collect()] == [("b", 5.7, 11.356)]
