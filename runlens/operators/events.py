"""Named events: triggers, their windows, and what holds after, before, during and between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.detect import ordered, run_starts, threshold_crossing


def crossing_event(samples: DataFrame, name: str, value: float, direction: str, hysteresis: float = 0.0, debounce: float = 0.0) -> DataFrame:
    """run_id, event, k (from 1), t, of the accepted crossings in one direction."""
    found = threshold_crossing(samples, value, edge=direction, hysteresis=hysteresis, debounce=debounce).select("run_id", F.col("crossing").alias("t"))
    return number(found, name)


def equals_event(samples: DataFrame, name: str, hit: Column) -> DataFrame:
    """run_id, event, k, t of the first sample of each run of `hit`."""
    return number(run_starts(samples, hit).select("run_id", "t"), name)


def number(found: DataFrame, name: str) -> DataFrame:
    return found.select("run_id", F.lit(name).alias("event"), F.row_number().over(Window.partitionBy("run_id").orderBy("t")).alias("k"), "t")


def occurrence(events: DataFrame, which: str | int) -> DataFrame:
    """first, last, all, or the n-th trigger of each run."""
    if which == "all":
        return events
    if which == "last":
        w = Window.partitionBy("run_id").orderBy(F.desc("k"))
        return events.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return events.where(F.col("k") == (1 if which == "first" else int(which)))


def windows(samples: DataFrame, events: DataFrame, before: float, after: float) -> DataFrame:
    """Samples within [t - before, t + after] of a trigger, and one more on each side; clipped marks windows beyond the signal.

    Few triggers meet many samples of the same run, so the join is by run and the ranges are compared.
    """
    w = ordered(samples)
    d = samples.select("run_id", "signal", "idx", "t", F.lag("t").over(w).alias("tp"), F.lead("t").over(w).alias("tn"))
    e = events.select("run_id", "k", (F.col("t") - before).alias("lo"), (F.col("t") + after).alias("hi"))
    inside = (F.coalesce("tn", "t") >= F.col("lo")) & (F.coalesce("tp", "t") <= F.col("hi"))
    hit = d.join(e, "run_id").where(inside)
    g = hit.groupBy("run_id", "signal", "k", "lo", "hi").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("samples"))
    ends = samples.groupBy("run_id", "signal").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return g.join(ends, ["run_id", "signal"]).select("run_id", "signal", "k", "first_idx", "last_idx", "samples", ((F.col("lo") < F.col("t0")) | (F.col("hi") > F.col("t1"))).alias("clipped"))


def attach(frame: DataFrame, events: dict[str, DataFrame]) -> DataFrame:
    """One array column `e_<name>` of trigger times for each event: no row is repeated."""
    for name, e in events.items():
        times = e.groupBy("run_id").agg(F.array_sort(F.collect_list("t")).alias(f"e_{name}"))
        frame = frame.join(times, "run_id", "left").withColumn(f"e_{name}", F.coalesce(f"e_{name}", F.array().cast("array<double>")))
    return frame


def first(times: Column) -> Column:
    return F.get(times, 0)


def nth(times: Column, n: int) -> Column:
    """The n-th trigger, from 1; null where there are fewer."""
    return F.get(times, n - 1)


def after(t: Column, times: Column, delay: float = 0.0) -> Column:
    """From any of the triggers on; never without one."""
    return F.exists(times, lambda e: t >= e + F.lit(delay))


def before(t: Column, times: Column, delay: float = 0.0) -> Column:
    """Until the first trigger; always without one."""
    return F.coalesce(t < first(times) + F.lit(delay), F.lit(True))


def during(t: Column, times: Column, length: float) -> Column:
    """From any of the triggers for a while."""
    return F.exists(times, lambda e: (t >= e) & (t < e + F.lit(length)))


def between(t: Column, starts: Column, ends: Column) -> Column:
    """From a trigger of the first event to the next of the second; to the end of the run where there is none."""
    closing = lambda a: F.array_min(F.filter(ends, lambda b: b >= a))
    return F.exists(starts, lambda a: (t >= a) & F.coalesce(t < closing(a), F.lit(True)))


def since(t: Column, times: Column) -> Column:
    """Seconds since the first trigger; null before it."""
    return F.when(t >= first(times), t - first(times))
