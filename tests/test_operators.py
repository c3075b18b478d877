"""Operators against plain loops: many random runs in one plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

import loops
from runlens.operators import detect as D
from runlens.operators import resample as R
from runlens.plans import preview as P


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(5)
    out = {}
    for r in range(60):
        n, t, now = rng.randint(1, 40), [], 0.0
        for _ in range(n):
            now += rng.choice([0.0, 0.5, 1.0, 2.0])
            t.append(now)
        out[r] = (t, [rng.choice([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, None]) for _ in range(n)])
    return out


@pytest.fixture(scope="module")
def frame(spark, runs):
    rows = [(r, "s", i, t, x) for r, (ts, xs) in runs.items() for i, (t, x) in enumerate(zip(ts, xs))]
    return spark.createDataFrame(rows, "run_id int, signal string, idx long, t double, x double").cache()


@pytest.mark.parametrize("h,d,edge", [(0.0, 0.0, "both"), (2.0, 0.0, "both"), (2.0, 1.5, "both"), (0.0, 1.0, "rising"), (1.0, 3.0, "falling")])
def test_threshold_crossing(frame, runs, h, d, edge):
    got = {}
    for r in D.threshold_crossing(frame, 2.5, hysteresis=h, debounce=d, edge=edge).orderBy("run_id", "confirm").collect():
        got.setdefault(r.run_id, []).append((r.crossing, r.edge, r.index_before, r.index_after, r.confirm))
    for r, (t, x) in runs.items():
        assert got.get(r, []) == loops.crossings(t, x, 2.5, h, d, edge), r


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_violation(frame, runs, least):
    got = {}
    for r in D.violation(frame, above=2.0, min_duration=least).orderBy("run_id", "first_idx").collect():
        got.setdefault(r.run_id, []).append((r.start, r.end, r.worst_idx))
    for r, (t, x) in runs.items():
        assert got.get(r, []) == loops.violations(t, x, 2.0, least), r


def test_local_extrema(frame, runs):
    got = {}
    for r in D.local_extrema(frame, 1.0, kind="max").orderBy("run_id", "idx").collect():
        got.setdefault(r.run_id, []).append((r.idx, r.value, r.prominence))
    for r, (t, x) in runs.items():
        assert got.get(r, []) == loops.peaks(x, 1.0), r


def test_one_exchange(frame):
    """Windows that share a partitioning need one shuffle."""
    for df in (D.threshold_crossing(frame, 2.5, hysteresis=1.0, debounce=1.0), D.state_transitions(frame, "x"), D.gap_retention(frame), D.violation(frame, above=2.0)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_extrema_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "s", 0, 0.0, 3.0), (1, "s", 1, 1.0, 3.0), (2, "s", 0, 0.0, None)], "run_id int, signal string, idx long, t double, x double")
    rows = D.global_extrema(df).collect()
    assert [(r.run_id, r.max_idx, r.min_idx) for r in rows] == [(1, 0, 0)]
    assert D.global_extrema(df.where("false")).count() == 0


def test_negative_zero_is_a_change(spark):
    df = spark.createDataFrame([(1, "s", i, float(i), x) for i, x in enumerate([0.0, -0.0, float("nan"), float("nan"), 1.0])], "run_id int, signal string, idx long, t double, x double")
    assert [r.idx for r in D.state_transitions(df, "x").orderBy("idx").collect()] == [0, 1, 2, 4]


def test_resample_repeated_times_and_gaps(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 1.0, 4.0), (1, 3, 2.0, None), (1, 4, 3.0, 8.0)], "run_id int, idx long, t double, x double")
    g = spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 1.0), (1, 1.5), (1, 2.5), (1, 3.0), (1, 4.0)], "run_id int, t double")
    lin = [r.x for r in R.resample_linear(s, g).orderBy("t").collect()]
    assert lin == [None, 1.5, 4.0, None, None, 8.0, None]
    assert [r.x for r in R.resample_hold(s, g).orderBy("t").collect()] == [None, 1.0, 4.0, 4.0, None, 8.0, 8.0]


def test_preview_is_a_prefix(frame):
    rows = {(r.run_id, r["rank"]): r.idx for r in P.preview_rank(frame, 2).collect()}
    more = {(r.run_id, r["rank"]): r.idx for r in P.preview_rank(frame, 4).collect()}
    assert all(more[k] == v for k, v in rows.items())


def test_detection_survives_retention(frame):
    out = P.verify_crossings(frame, 2.5, hysteresis=1.0, debounce=1.0).agg(F.sum("claimed"), F.sum("found"), F.sum("unmatched")).first()
    assert out[0] == out[1] > 0 and out[2] == 0


def test_raising_a_limit_never_adds_time(frame):
    time = lambda v: D.violation(frame, above=v).agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0.0
    assert time(1.0) >= time(2.0) >= time(4.0) and math.isfinite(time(1.0))


def test_no_frame_runs_to_the_end(spark):
    """Such a frame is gone over again for every row; and a long signal is read in time."""
    import time

    from pyspark.sql import functions as F

    from runlens.functions.aggregates import movmean
    from runlens.operators.resample import reconstruction_error, resample_linear, sync_groups

    n = 300_000
    one = spark.range(n).select(F.lit(1).alias("run_id"), F.lit("s").alias("signal"), F.col("id").alias("idx"), (F.col("id") / 10).alias("t"), F.sin(F.col("id") / 1000).alias("x"))
    grid = spark.range(n).select(F.lit(1).alias("run_id"), (F.col("id") / 10 + 0.05).alias("t"))
    kept = one.where(F.col("idx") % 100 == 0).select("run_id", "signal", "idx")
    frames = [resample_linear(one, grid), reconstruction_error(one, kept), movmean(one, 5.0), sync_groups(one, one)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing", "")
    began = time.time()
    assert frames[0].where("x is not null").count() == n - 1
    assert frames[1].first().max_error < 0.01  # the last samples have no knot after them
    assert frames[2].where("mean is not null").count() == n
    assert time.time() - began < 120


@pytest.mark.parametrize("separation", [1.0, 2.5])
def test_separated_extrema(frame, runs, separation):
    """The highest peak first, the lowest index among equals; a peak stays if none that stays is too near."""
    every, kept = D.local_extrema(frame, 1.0).collect(), D.local_extrema(frame, 1.0, separation=separation).collect()
    want = set()
    for run, kind in {(r.run_id, r.kind) for r in every}:
        stays = []
        for p in sorted((r for r in every if (r.run_id, r.kind) == (run, kind)), key=lambda r: (-r.value if kind == "max" else r.value, r.idx)):
            if all(abs(runs[run][0][p.idx] - o) >= separation for o in stays):
                stays.append(runs[run][0][p.idx])
                want.add((run, kind, p.idx))
    assert {(r.run_id, r.kind, r.idx) for r in kept} == want and len(kept) == len(want) < len(every)
