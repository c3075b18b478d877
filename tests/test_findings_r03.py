"""What the third round of findings told, on small tables."""

import glob

import pytest
from pyspark.sql import functions as F

from runlens import catalog_queries
from runlens import samples as S
from runlens.operators import detect as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with the events of the smallest tables, of which some values are 0."""
    folder = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("value", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_f2_logarithm_of_zero(spark, events):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    want = {r[:2]: r[2:] for r in con.execute(catalog_queries.oracle_sql()["expr_trig"]).fetchall()}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in catalog_queries.queries()["expr_trig"](spark, events).collect()}
    assert got == want and any(v[3] == float("-inf") for v in got.values())


def test_f1_stream_tells_files(spark, monkeypatch):
    """No sink in the driver's memory, and samples aren't drawn into one task."""
    df = catalog_queries.queries()["stream_window_extrema"](spark, SF)
    assert df.inputFiles() and all(f.endswith(".parquet") for f in df.inputFiles())


def test_f4_tasks_grow_with_the_files(spark, monkeypatch):
    """The exchange by run has a task for each PART bytes, so that more runs don't make its tasks larger."""
    monkeypatch.setattr(S, "PART", 20_000, raising=False)
    size = len(open(f"{SF}/lineitem.parquet", "rb").read())
    for make in (S.lineitem_samples, S.event_samples, S.event_wide):
        assert make(spark, SF).rdd.getNumPartitions() >= (size // 20_000 if make is S.lineitem_samples else 2)
    out = catalog_queries.queries()["req_bound_strict"](spark, SF)
    assert out.rdd.getNumPartitions() >= size // 20_000


@pytest.mark.parametrize("name", ["req_bound_discrete", "global_extrema_lineitem"])
def test_f5_f13_tasks_of_the_query(spark, monkeypatch, name):
    few = {tuple(r) for r in catalog_queries.queries()[name](spark, SF).collect()}
    monkeypatch.setattr(S, "PART", 20_000, raising=False)
    out = catalog_queries.queries()[name](spark, SF)
    assert out.rdd.getNumPartitions() >= len(open(f"{SF}/lineitem.parquet", "rb").read()) // 20_000
    assert {tuple(r) for r in out.collect()} == few


def test_f7_buckets_without_a_join(spark):
    """Which buckets exist is told by the same aggregate: one exchange, no second reading of the samples."""
    rows = [(1, "s", 0, 5.0, 1.0), (1, "s", 1, 20.0, 3.0), (1, "s", 2, 41.0, None), (1, "s", 3, 50.0, 2.0)]
    df = spark.createDataFrame(rows, "run_id int, signal string, idx long, t double, x double")
    out = D.window_extrema(df, 10.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # 20 is also of bucket 1, which no sample makes exist; 50 also of bucket 4, which the gap at 41 makes exist
    assert sorted((r.bucket, r.max_value, r.max_idx, r.min_idx) for r in out.collect()) == [(0, 1.0, 0, 0), (2, 3.0, 1, 1), (4, 2.0, 3, 3), (5, 2.0, 3, 3)]


def test_f8_one_pass_of_batches(spark):
    """Peaks and their separation need one exchange and no call for each signal; signals may be cut by batches."""
    rows = [(r, "s", i, float(i), float((i * 7 + r) % 11) if i % 13 else None) for r in range(40) for i in range(97)]
    df = spark.createDataFrame(rows, "run_id int, signal string, idx long, t double, x double")
    out = D.local_extrema(df, 2.0, separation=5.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroups" not in plan and "Join" not in plan
    whole = sorted(map(tuple, out.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert sorted(map(tuple, out.collect())) == whole and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_f3_relaxations_detect_once(spark):
    """The looser parameters come from one detection of each requirement, with the counts of detections of their own."""
    from dataclasses import replace

    from runlens.plans import compile as plan
    from runlens.plans import policy

    s = S.event_samples(spark, SF)
    p = policy.load("version: 1\nhard: {value: {local_extrema: {prominence: 30 m}, violation: {above: 60 m, min_duration: 6 h}}}", ["value"], {"value": "m"})
    out = plan.relaxations(s, p)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 3  # two detections, and the runs
    got = {(r.run_id, r.requirement, r.change): r.samples for r in out.collect() if r.change != "drop"}
    want = {}
    for h in p.hard:
        key = "prominence" if h.op == "local_extrema" else "min_duration"
        for f in (2.0, 4.0):
            marks = plan.hard_samples(s, replace(h, params={**h.params, key: h.params[key] * f}))[0]
            kept = {(r.run_id, r.idx) for m in marks for r in m.collect()}
            for run, _ in kept:
                want[run, h.id, f"{key} x {f:g}"] = sum(1 for r, _ in kept if r == run)
    assert got == want
