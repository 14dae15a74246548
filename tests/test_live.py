"""Publication, incremental replica, quarantine and running statistics."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from strata.sources import publish as P
from strata.sources import quarantine as Q
from strata.streaming import apply_changes, current_rows, run_to_completion
from strata.streaming import replica as R
from strata.streaming import running as N
from tests.helpers import rows


# ------------------------------------------------------------------ publication
def test_reader_sees_old_or_new_and_columns_may_change(spark, tmp_path):
    base, name = str(tmp_path / "t"), "pub_switch"
    P.publish(spark.range(100).withColumn("v", F.lit(1)), name, base)
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append(tuple(spark.table(name).agg(F.count("*"), F.min("v"), F.max("v")).first()))

    t = threading.Thread(target=reader)
    t.start()
    try:
        for v in (2, 3, 4):
            P.publish(spark.range(100).withColumn("v", F.lit(v)), name, base)
    finally:
        stop.set()
        t.join()
    assert seen and all(n == 100 and lo == hi for n, lo, hi in seen)  # whole versions only
    old_plan = spark.table(name)
    P.publish(spark.range(7).select(F.col("id").cast("string").alias("id"), F.lit(True).alias("new")), name, base)
    assert spark.table(name).dtypes == [("id", "string"), ("new", "boolean")] and spark.table(name).count() == 7
    assert old_plan.count() == 100  # a plan made before goes on reading its version
    assert P.rollback(spark, name) and spark.table(name).count() == 100
    left = P.versions(spark, name)
    assert P.expire(spark, name, keep=1) == left[1:] and P.versions(spark, name) == left[:1]
    assert spark.table(name).agg(F.max("v")).first()[0] == 4
    with pytest.raises(ValueError):
        P.rollback(spark, name)


def test_failed_and_late_writers_change_nothing(spark, tmp_path):
    base, name = str(tmp_path / "t"), "pub_conflict"
    first = P.publish(spark.range(10), name, base)
    broken = spark.range(10).select(F.raise_error(F.concat(F.lit("no "), F.col("id"))).cast("string").alias("id"))
    with pytest.raises(Exception, match="no "):
        P.publish(broken, name, base)
    assert P.versions(spark, name) == [first] and spark.table(name).count() == 10
    second = P.publish(spark.range(20), name, base, started_from=first)
    with pytest.raises(P.Conflict):
        P.publish(spark.range(30), name, base, started_from=first)
    assert P.versions(spark, name) == [second, first] and spark.table(name).count() == 20
    with pytest.raises(P.Conflict):
        P.publish(spark.range(5), name, base, started_from=None)


def test_compaction_keeps_rows_and_lessens_files(spark, tmp_path):
    base, name = str(tmp_path / "t"), "pub_compact"
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(9)
    P.publish(df, name, base)
    assert len(spark.table(name).inputFiles()) == 9
    P.compact_published(spark, name, base, sort_cols=["k"])
    assert len(spark.table(name).inputFiles()) == 1 and rows(spark.table(name)) == rows(df)
    assert P.versions(spark, "never_published") == []


# ------------------------------------------------------------------ replica
CHANGES = "k long, seq int, op string, a string, b double"


def _files(spark, path):
    return {f.split("__range=")[1].split("/")[0]: f for f in spark.read.parquet(f"{path}/rows").inputFiles()}


def test_only_touched_ranges_are_read_and_written(spark, tmp_path):
    path = str(tmp_path / "r")
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("a"), F.col("id").cast("double").alias("b"))
    R.create_replica(base, path, "k", 100)
    before = _files(spark, path)
    ch = spark.createDataFrame([(150, 1, "U", "new", None), (151, 1, "D", None, None), (1050, 1, "U", "added", 2.0)], CHANGES)
    assert R.apply_batch(spark, path, ch, "k", 100, "seq", 0) == 2
    after = _files(spark, path)
    assert {p for p in after if before.get(p) != after[p]} == {"1", "10"}
    plan = R.touched_rows(spark, path, [1, 10])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__range" in plan.split("PartitionFilters")[1].split("\n")[0]
    scanned = R.touched_rows(spark, path, [1, 10]).select(F.input_file_name()).distinct().count()
    assert scanned == 2
    got = {r.k: (r.a, r.b) for r in R.read_replica(spark, path).where("k IN (150, 151, 1050, 152)").collect()}
    assert got == {150: ("new", 150.0), 152: ("x", 152.0), 1050: ("added", 2.0)}


def test_replica_equals_full_application_and_replays_change_nothing(spark, tmp_path):
    rnd, path = random.Random(3), str(tmp_path / "r")
    base = spark.createDataFrame([(k, rnd.choice("pq"), float(k)) for k in range(0, 60, 2)], "k long, a string, b double")
    R.create_replica(base, path, "k", 7)
    full = base
    for batch in range(6):
        ch = [(rnd.randrange(-5, 70), s, rnd.choice("UUD"), rnd.choice(["m", None]), rnd.choice([1.5, None])) for s in range(25)]
        if batch == 2:
            ch = [(k, 1, "D", None, None) for k in range(-5, 70)]  # every range loses all its rows
        ch = spark.createDataFrame(ch, CHANGES)
        full = spark.createDataFrame(current_rows(apply_changes(full, ch, ["k"], "seq")).collect(), base.schema)
        assert R.apply_batch(spark, path, ch, "k", 7, "seq", batch) > 0
        assert rows(R.read_replica(spark, path)) == rows(full)
        assert R.apply_batch(spark, path, ch, "k", 7, "seq", batch) == 0  # noted: skipped
    # a batch that ended after its rows and before its note is run again
    R.apply_batch(spark, path, ch, "k", 7, "seq", 99)
    assert rows(R.read_replica(spark, path)) == rows(spark.createDataFrame(
        current_rows(apply_changes(full, ch, ["k"], "seq")).collect(), base.schema))
    assert R.apply_batch(spark, path, ch.limit(0), "k", 7, "seq", 100) == 0


def test_stream_of_changes(spark, tmp_path):
    path, land = str(tmp_path / "r"), str(tmp_path / "in")
    R.create_replica(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, a string, b double"), path, "k", 10)
    for i in range(3):
        spark.createDataFrame([(1, i, "U", f"s{i}", None), (20 + i, i, "U", "n", 0.0)], CHANGES).coalesce(1).write.mode("append").parquet(land)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(land)
    run_to_completion(R.replicate(stream, path, "k", 10, "seq", str(tmp_path / "ck")))
    got = {r.k: r.a for r in R.read_replica(spark, path).collect()}
    assert got.keys() == {1, 2, 20, 21, 22} and got[1].startswith("s")


# ------------------------------------------------------------------ quarantine
def test_every_line_is_typed_or_rejected_with_its_reason(spark, tmp_path):
    lines = ['{"id": 1, "at": "2024-01-02 03:04:05", "v": 1.5}', '{"id": "2", "at": "2024-01-02 03:04:05", "v": "7"}', '{"id": 3, "v": 1}',
             '{"id": 4, "at": "x", "v": 1}', '{"id": 5.5, "at": "2024-01-02 03:04:05"}', '{"id": 6, ', "", "   ", "[1]", '"text"',
             '{"at": "2024-01-02 03:04:05"}', '{"id": 7, "at": "2024-01-02 03:04:05", "v": null, "more": {"x": 1}}']
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    schema = "id bigint, at timestamp, v double"
    good, bad = Q.split_rows(Q.parse_lines(df, schema, required=["id", "at"]))
    assert sorted(r.id for r in good.collect()) == [1, 2, 7]
    assert {r.id: r.v for r in good.collect()} == {1: 1.5, 2: 7.0, 7: None}
    reasons = {r.raw: r.reason for r in bad.collect()}
    assert reasons[lines[2]] == "missing:at" and reasons[lines[3]] == "type:at" and reasons[lines[4]] == "type:id"
    assert reasons[lines[10]] == "missing:id" and all(reasons[x] == "malformed" for x in ['{"id": 6, ', "", "   ", None])
    assert good.count() + bad.count() == len(lines) + 1
    src = str(tmp_path / "in")
    df.where("value IS NOT NULL").repartition(4).write.text(src)
    run_to_completion(Q.quarantine_stream(spark.readStream.option("maxFilesPerTrigger", 1).text(src), schema, str(tmp_path / "out"), ["id", "at"]))
    sgood, sbad = Q.read_quarantine(spark, str(tmp_path / "out"))
    assert rows(sgood) == rows(good)
    assert sorted(r.reason for r in sbad.collect()) == sorted(r.reason for r in bad.where("raw IS NOT NULL").collect())


# ------------------------------------------------------------------ running statistics
def test_merged_moments_equal_one_pass(spark, tmp_path):
    rnd = random.Random(8)
    data = [(rnd.choice("ab"), 1e9 + rnd.random()) for _ in range(500)] + [("one", 4.0), ("nul", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for i, part in enumerate(df.randomSplit([1.0] * 5, seed=1)):
        N.moments(part, "g", "v").write.parquet(f"{tmp_path}/p/batch_id={i}")
    parts = spark.read.parquet(f"{tmp_path}/p")
    got = {r.g: (r.avg_val, r.stdev_val) for r in N.stats_of(parts, "g").collect()}
    want = {r.g: (r.a, r.s) for r in df.groupBy("g").agg(F.avg("v").alias("a"), F.stddev("v").alias("s")).where("a IS NOT NULL").collect()}
    assert got.keys() == want.keys() and got["one"] == (4.0, None)
    for g in "ab":
        assert abs(got[g][0] - want[g][0]) < 1e-6 and abs(got[g][1] - want[g][1]) < 1e-6
    N.merge_parts(spark, f"{tmp_path}/p", "g", f"{tmp_path}/m")
    again = {r.g: r.avg_val for r in N.stats_of(spark.read.parquet(f"{tmp_path}/m"), "g").collect()}
    assert all(abs(again[g] - got[g][0]) < 1e-6 for g in got)


def test_top_groups_of_the_last_batch(spark, tmp_path):
    land, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1.0), ("b", 5.0)], [("a", 9.0), ("c", 4.0)], [("c", 4.0)]):
        spark.createDataFrame(part, "g string, v double").coalesce(1).write.mode("append").parquet(land)
    stream = spark.readStream.schema("g string, v double").option("maxFilesPerTrigger", 1).parquet(land)
    run_to_completion(N.top_groups_stream(stream, "g", "v", sink, str(tmp_path / "ck"), k=2))
    assert {r.g: r.avg_v for r in N.read_newest(spark, sink).collect()} == {"a": 5.0, "b": 5.0}
    assert spark.read.parquet(sink).select("batch_id").distinct().count() == 3
