"""As-of reads of one clock at the times of another: one union and one sort for each run, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bracketed(samples: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """Grid rows with the samples around them: `left` the last at or before, `right` the first after; (t, x, idx) each."""
    none = F.lit(None)
    s = samples.select(*on, "t", F.lit(0).alias("is_query"), F.col("idx"), F.struct("t", "x", "idx").alias("s"))
    q = grid.select(*on, "t", F.lit(1).alias("is_query"), none.cast("long").alias("idx"), none.cast(s.schema["s"].dataType).alias("s"))
    names = ("t", "is_query", "idx")
    both, by = s.unionByName(q), Window.partitionBy(*on)
    # two running frames, one for each direction: a frame to the end of the run would be gone over again for every row
    left = F.last("s", ignorenulls=True).over(by.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))
    right = F.last("s", ignorenulls=True).over(by.orderBy(*map(F.desc, names)).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("left", left).withColumn("right", right).where("is_query = 1")


def resample_linear(samples: DataFrame, grid: DataFrame, on: list[str] = ("run_id",)) -> DataFrame:
    """Linear reading at grid times: a sample at the time itself counts, the later of repeated ones; null next to a gap and outside."""
    b = _bracketed(samples, grid, list(on))
    w = (F.col("t") - F.col("left.t")) / F.nullif(F.col("right.t") - F.col("left.t"), F.lit(0.0))
    x = F.when(F.col("left.t") == F.col("t"), F.col("left.x")).otherwise(F.col("left.x") + w * (F.col("right.x") - F.col("left.x")))
    return b.select(*on, "t", x.alias("x"))


def resample_hold(samples: DataFrame, grid: DataFrame, on: list[str] = ("run_id",)) -> DataFrame:
    """The last sample at or before each grid time; null before the first."""
    return _bracketed(samples, grid, list(on)).select(*on, "t", F.col("left.x").alias("x"))


def grid_union(*clocks: DataFrame) -> DataFrame:
    """Distinct times of several clocks, by run."""
    out = clocks[0].select("run_id", "t")
    for c in clocks[1:]:
        out = out.unionByName(c.select("run_id", "t"))
    return out.distinct()


def curve(x: Column, points: list[tuple[float, float]], mode: str = "linear", outside: str = "hold") -> Column:
    """Look-up in a table of ascending points: linear, or steps that hold to the right. outside: hold the ends, or none."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    value = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
    value = value.when(x < xs[0], F.lit(ys[0]) if outside == "hold" else F.lit(None).cast("double"))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        inside = F.lit(y0) if mode == "step" else F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        value = value.when(x < x1, inside)
    value = value.when(x == xs[-1], F.lit(ys[-1]))
    return value.otherwise(F.lit(ys[-1]) if outside == "hold" else F.lit(None).cast("double"))


def sync_groups(samples: DataFrame, propagating: DataFrame) -> DataFrame:
    """Every time of a propagating sample on every signal of its run.

    Columns: run_id, signal, t, status (aligned, unaligned, out_of_range), index (first exact), index_before, index_after.
    """
    times = propagating.select("run_id", "t").distinct()
    members = samples.groupBy("run_id", "signal").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    asked = times.join(members, "run_id")
    b = _bracketed(samples, asked.select("run_id", "signal", "t"), ["run_id", "signal"]).select("run_id", "signal", "t", "left", "right")
    exact = samples.groupBy("run_id", "signal", "t").agg(F.min("idx").alias("index"))
    d = b.join(exact, ["run_id", "signal", "t"], "left").join(members, ["run_id", "signal"])
    status = F.when(F.col("index").isNotNull(), "aligned").when((F.col("t") < F.col("t0")) | (F.col("t") > F.col("t1")), "out_of_range").otherwise("unaligned")
    return d.select("run_id", "signal", "t", status.alias("status"), "index", F.when(status == "unaligned", F.col("left.idx")).alias("index_before"), F.when(status == "unaligned", F.col("right.idx")).alias("index_after"))


def reconstruction_error(samples: DataFrame, retained: DataFrame) -> DataFrame:
    """Largest distance of the finite samples from the line through the retained ones, by signal."""
    keys = ["run_id", "signal"]
    knots = samples.join(retained.select(*keys, "idx").distinct(), [*keys, "idx"], "left_semi")
    so_far = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = samples.join(knots.select(*keys, "idx", F.lit(True).alias("kept")), [*keys, "idx"], "left")
    knot = F.when(F.col("kept"), F.struct("t", "x"))
    d = own.withColumn("a", F.last(knot, ignorenulls=True).over(so_far("idx"))).withColumn("b", F.last(knot, ignorenulls=True).over(so_far(F.desc("idx"))))
    share = (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    guess = F.coalesce(F.col("a.x") + share * (F.col("b.x") - F.col("a.x")), F.col("a.x"))
    return d.groupBy(*keys).agg(F.max(F.when(F.col("kept").isNull(), F.abs(F.col("x") - guess))).alias("max_error"), F.count("kept").alias("retained"), F.count(F.lit(1)).alias("samples"))
