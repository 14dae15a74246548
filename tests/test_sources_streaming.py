"""Sources, sinks, streaming and change propagation — property tests."""

import os
import tempfile

from pyspark.sql import functions as F

from strata import sources as SRC
from strata import streaming as T
from tests.conftest import SMOKE
from tests.helpers import rows


def _tmp():
    return tempfile.mkdtemp(prefix="strata-test-")


def test_read_csv_inferred_declared_and_bad_rows(spark):
    d = _tmp()
    p = os.path.join(d, "sensors.csv")
    with open(p, "w") as fh:
        fh.write("reading_id,temperature,reading_date\nr1,21.5,2024-01-02\nr2,oops,2024-01-03\nr3,19.0,bad\n")
    inferred = SRC.read_csv(spark, p)
    assert dict(inferred.dtypes)["temperature"] == "string"
    declared = SRC.read_csv(spark, p, "reading_id string, temperature double, reading_date string",
                            date_cols={"reading_date": "yyyy-MM-dd"})
    got = {r.reading_id: (r.temperature, r.reading_date) for r in declared.collect()}
    assert got["r1"][0] == 21.5 and got["r2"][0] is None and got["r3"][1] is None
    dropped = SRC.read_csv(spark, p, "reading_id string, temperature double, reading_date string", on_bad="drop")
    assert sorted(r.reading_id for r in dropped.collect()) == ["r1", "r3"]
    stamped = SRC.bronze_stamp(declared, "b1")
    r = stamped.collect()[0]
    assert r.batch_id == "b1" and r.source_file.endswith("sensors.csv") and r.ingestion_timestamp is not None


def test_write_append_read_table_and_audit(spark):
    df = spark.read.parquet(f"{SMOKE}/region.parquet")
    SRC.write_table(df, "t_region_test")
    SRC.append_table(df, "t_region_test")
    assert SRC.read_table(spark, "t_region_test").count() == 2 * df.count()
    audit = {r.table_name: (r.row_count, r.error) for r in
             SRC.audit_counts(spark, {"ok": "t_region_test", "missing": "no_such_table"}).collect()}
    assert audit["ok"] == (10, None)
    assert audit["missing"][0] is None and audit["missing"][1]


def test_compact_keeps_row_set(spark):
    df = spark.read.parquet(f"{SMOKE}/orders.parquet").repartition(7)
    out = SRC.compact(df, os.path.join(_tmp(), "orders_compact"), 2, ["o_orderdate"])
    assert rows(out) == rows(df)
    assert out.rdd.getNumPartitions() <= 2


def test_capped_load_is_ordered_and_deduped(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (1, "a"), (2, "x")], "k int, v string")
    out = [(r.k, r.v) for r in SRC.capped_load(df, ["k"], 2).collect()]
    assert out == [(1, "a"), (2, "x")]


def test_infer_types_and_widths(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "2024-01-01 00:00:00", "", "x"),
                                ("", "2", "false", "2024-01-02", "", "12")],
                               "a string, b string, c string, d string, e string, f string")
    got = {r.column: r.inferred_type for r in SRC.infer_types(df).collect()}
    assert got == {"a": "long", "b": "real", "c": "bool", "d": "datetime", "e": "string", "f": "string"}
    w = {r.column: (r.max_length, r.declared_width) for r in SRC.string_widths(df, ["f"]).collect()}
    assert w == {"f": (2, 50)}


def test_cast_by_spec(spark):
    df = spark.createDataFrame([("12.345", "2024-01-02 03:04:05.123", "abc", "1")],
                               "p string, t string, s string, b string")
    r = SRC.cast_by_spec(df, {"p": "DECIMAL(10,2)", "t": "DATETIME2(3)", "s": "NVARCHAR(10)", "b": "BIT"}).collect()[0]
    assert str(r.p) == "12.35" and r.t.microsecond == 123000 and r.s == "abc" and r.b is True


def test_batch_equals_stream_windows(spark):
    from strata.plans.stream_q import stream_events_per_minute

    batch = T.tumbling_count(spark.read.parquet(f"{SMOKE}/events.parquet"), "ts", "1 minute")
    assert rows(stream_events_per_minute(spark, SMOKE)) == rows(batch)


def test_apply_changes_twice_equals_once(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, s string, v double")
    ch = spark.createDataFrame([(1, 1, "U", "A", None), (1, 2, "U", None, 9.0), (2, 1, "D", None, None),
                                (4, 1, "U", "new", 4.0)], "k int, seq int, op string, s string, v double")
    once = T.apply_changes(base, ch, ["k"], "seq")
    got = {r.k: (r.s, r.v, r.change) for r in once.collect()}
    # each column takes its last change; NULL fields change nothing
    assert got == {1: ("A", 9.0, "updated"), 2: ("b", 2.0, "deleted"), 3: ("c", 3.0, "unchanged"),
                   4: ("new", 4.0, "inserted")}
    cur = T.current_rows(once)
    twice = T.current_rows(T.apply_changes(cur, ch, ["k"], "seq"))
    assert rows(twice.filter(F.col("k") != 2)) == rows(cur)


def test_replica_diff_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.004, "x"), (2, 2.5, "y"), (4, 4.0, "w")], "k int, v double, s string")
    got = {r.k: r.diff for r in T.replica_diff(a, b, ["k"], tol=0.01).collect()}
    assert got == {2: "v", 3: "missing_in_replica", 4: "extra_in_replica"}


def test_sigma_outliers_stream_static_join(spark):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    stats = T.group_stats(ev, "user_id", "value")
    a = T.sigma_outliers(ev, "user_id", "value", 2.0, stats=stats)
    b = T.sigma_outliers(ev, "user_id", "value", 2.0)
    assert rows(a) == rows(b)


def test_changes_apply_one_after_another(spark):
    """Two partial updates, a delete followed by an insert, a late re-open."""
    base = spark.createDataFrame([(1, 10.0, "P", "a"), (2, 20.0, "O", "b"), (3, 30.0, "O", "c"), (4, 40.0, "P", "d")],
                                 "k long, price double, st string, other string")
    ch = spark.createDataFrame([(1, 1, "U", 110.0, "F"), (1, 3, "U", None, "O"), (2, 1, "D", None, None),
                                (2, 2, "U", 5.0, None), (3, 1, "U", 31.0, None), (3, 2, "D", None, None),
                                (5, 1, "U", 1.0, "N"), (6, 1, "D", None, None)],
                               "k long, seq int, op string, price double, st string")
    got = {r.k: tuple(r)[1:] for r in T.apply_changes(base, ch, ["k"], "seq").collect()}
    assert got == {1: (110.0, "O", "a", "updated"), 2: (5.0, None, None, "updated"), 3: (30.0, "O", "c", "deleted"),
                   4: (40.0, "P", "d", "unchanged"), 5: (1.0, "N", None, "inserted")}


def test_streams_read_a_folder_in_several_batches(spark):
    """events.parquet as a folder of files out of order: stream = batch."""
    from strata.plans import stream_q as S

    d = _tmp()
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(5).write.parquet(os.path.join(d, "events.parquet"))
    assert S.stream_append_events(spark, d).count() == ev.count()
    sink = S._scratch(spark, "sink-test")
    agg = S.tumbling_count(S._events_stream(spark, d, max_files=1), "ts", "1 minute")
    assert T.run_to_completion(S.upsert_windows(agg, sink, ["window_start"])) == 0
    assert len({r[0] for r in spark.read.parquet(sink).select(T.BATCH).distinct().collect()}) >= 5
    got = T.read_upserted(spark, sink, ["window_start"])
    want = S.events_per_minute(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    late = S._scratch(spark, "sink-late")
    marked = S.tumbling_count(S._events_stream(spark, d, max_files=1), "ts", "1 minute", watermark="1 minute")
    assert T.run_to_completion(S.upsert_windows(marked, late, ["window_start"])) > 0  # counted, not silent


def test_compaction_is_sized_by_bytes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = SRC.compact(df, os.path.join(_tmp(), "c"), sort_cols=["o_orderdate"], file_bytes=SRC.stored_bytes(df) // 3)
    assert len(out.inputFiles()) in (3, 4) and out.count() == df.count()


def test_compaction_sorts_small_runs_and_writes_whole_files(spark, monkeypatch):
    """One value fills a third of the rows: it too is sorted in several runs."""
    p = os.path.join(_tmp(), "in")
    k = F.when(F.col("id") % 3 == 0, F.lit(50)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") * 7919 % 101)
    spark.range(60000).select(k.alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("s")).repartition(5).write.parquet(p)
    df = spark.read.parquet(p)
    sorted_in, plain = [], SRC.sorted_runs
    monkeypatch.setattr(SRC, "sorted_runs", lambda *a: sorted_in.append(plain(*a)) or sorted_in[-1])
    monkeypatch.setattr(SRC, "FILES_AT_ONCE", 2)
    at = os.path.join(_tmp(), "out")
    SRC.write_sized(df, at, ["k"], target_files=3, run_bytes=SRC.stored_bytes(df) // 24)
    out = spark.read.parquet(at)
    assert rows(out) == rows(df) and len(out.inputFiles()) == 3
    task_rows = [r["n"] for r in sorted_in[0].groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(task_rows) < 60000 / 8  # a file has 20000
    ranges = []
    for f in out.inputFiles():
        keys = [r["k"] for r in spark.read.parquet(f).coalesce(1).select("k").collect()]
        assert keys == sorted(keys, key=lambda x: (x is not None, x))
        ranges.append([(x is not None, x or 0) for x in (keys[0], keys[-1])])
    ranges.sort()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
