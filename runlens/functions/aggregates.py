"""Derived series and scalars of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.detect import keys_of, ordered


def deriv(df: DataFrame) -> DataFrame:
    """dx: the derivative of second order on uneven steps, one-sided at the ends, the plain difference where all steps are equal."""
    w, keys = ordered(df), keys_of(df)
    d = df.withColumn("tp", F.lag("t").over(w)).withColumn("tn", F.lead("t").over(w)).withColumn("xp", F.lag("x").over(w)).withColumn("xn", F.lead("x").over(w))
    span = Window.partitionBy(*keys)
    step = F.col("tn") - F.col("t")
    d = d.withColumn("even", F.min(step).over(span) == F.max(step).over(span))
    hs, hd, z = F.col("t") - F.col("tp"), F.col("tn") - F.col("t"), F.lit(0.0)
    inner = (hs * hs * F.col("xn") + (hd * hd - hs * hs) * F.col("x") - hd * hd * F.col("xp")) / F.nullif(hs * hd * (F.col("tn") - F.col("tp")), z)
    plain = (F.col("xn") - F.col("xp")) / F.nullif(F.lit(2.0) * hd, z)
    dx = F.when(F.col("tp").isNull(), (F.col("xn") - F.col("x")) / F.nullif(hd, z)).when(F.col("tn").isNull(), (F.col("x") - F.col("xp")) / F.nullif(hs, z)).when(F.col("even"), plain).otherwise(inner)
    return d.select(*keys, "idx", "t", dx.alias("dx"))


def movmean(df: DataFrame, width: float) -> DataFrame:
    """mean: over the time from t - width to t, by the integral of the line; the value itself where nothing is covered."""
    w, keys = ordered(df), keys_of(df)
    d = df.withColumn("tp", F.lag("t").over(w)).withColumn("xp", F.lag("x").over(w))
    good = F.col("x").isNotNull() & F.col("xp").isNotNull()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("t") - F.col("tp")
    d = d.withColumn("i", F.sum(F.when(good, step * 0.5 * (F.col("x") + F.col("xp"))).otherwise(0.0)).over(so_far)).withColumn("c", F.sum(F.when(good, step).otherwise(0.0)).over(so_far))
    d = d.withColumn("tq", F.greatest(F.col("t") - F.lit(width), F.min("t").over(Window.partitionBy(*keys))))
    point = F.struct("t", "i", "c")
    knots = d.select(*keys, F.col("t").alias("at"), F.lit(0).alias("is_query"), "idx", point.alias("p"), F.lit(None).cast("struct<t:double,i:double,c:double,x:double>").alias("q"))
    asked = d.select(*keys, F.col("tq").alias("at"), F.lit(1).alias("is_query"), "idx", F.lit(None).cast("struct<t:double,i:double,c:double>").alias("p"), F.struct("t", "i", "c", "x").alias("q"))
    running = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = ("at", "is_query", "idx")
    b = knots.unionByName(asked).withColumn("l", F.last("p", True).over(running(*names))).withColumn("r", F.last("p", True).over(running(*map(F.desc, names)))).where("is_query = 1")
    share = (F.col("at") - F.col("l.t")) / F.nullif(F.col("r.t") - F.col("l.t"), F.lit(0.0))
    at = lambda c: F.when(F.col("l.t") == F.col("at"), F.col(f"l.{c}")).otherwise(F.col(f"l.{c}") + share * (F.col(f"r.{c}") - F.col(f"l.{c}")))
    covered = F.col("q.c") - at("c")
    mean = F.when(covered > 0, (F.col("q.i") - at("i")) / covered).otherwise(F.col("q.x"))
    return b.select(*keys, "idx", F.col("q.t").alias("t"), mean.alias("mean"))


def scalars(df: DataFrame, active: Column | None = None, discrete: bool = False) -> DataFrame:
    """max, min, initial, final with their times; integral, time-weighted mean and root mean square; over active samples."""
    w, keys = ordered(df), keys_of(df)
    ok = F.col("x").isNotNull() & (F.coalesce(active, F.lit(False)) if active is not None else F.lit(True))
    d = df.withColumn("ok", ok).withColumn("tn", F.lead("t").over(w)).withColumn("xn", F.lead("x").over(w)).withColumn("okn", F.lead("ok").over(w))
    both = F.col("ok") if discrete else F.col("ok") & F.col("okn")
    dt = F.col("tn") - F.col("t")
    area = dt * F.col("x") if discrete else dt * 0.5 * (F.col("x") + F.col("xn"))
    square = dt * F.col("x") * F.col("x") if discrete else dt * (F.col("x") * F.col("x") + F.col("xn") * F.col("xn") + F.col("x") * F.col("xn")) / 3.0
    on = lambda c: F.when(F.col("ok"), c)
    g = d.groupBy(*keys).agg(
        F.max(on(F.struct("x", (-F.col("idx")).alias("i"), "t"))).alias("hi"), F.min(on(F.struct("x", "idx", "t"))).alias("lo"), F.min(on(F.struct("idx", "x", "t"))).alias("a"), F.max(on(F.struct("idx", "x", "t"))).alias("z"),
        F.sum(F.when(both, area)).alias("i"), F.sum(F.when(both, square)).alias("s"), F.sum(F.when(both, dt)).alias("c"), F.avg(on(F.col("x"))).alias("m"), F.avg(on(F.col("x") * F.col("x"))).alias("q"),
    )
    return g.select(
        *keys, F.col("hi.x").alias("max"), F.col("lo.x").alias("min"), F.col("a.x").alias("initial"), F.col("z.x").alias("final"), F.col("hi.t").alias("t_max"), F.col("lo.t").alias("t_min"), F.col("a.t").alias("t_initial"), F.col("z.t").alias("t_final"),
        F.coalesce("i", F.lit(0.0)).alias("integral"), F.when(F.col("c") > 0, F.col("i") / F.col("c")).otherwise(F.col("m")).alias("mean"), F.sqrt(F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(F.col("q"))).alias("rms"),
    )


def duration(df: DataFrame, hit: Column, discrete: bool = False) -> DataFrame:
    """Seconds in which a condition holds: between two samples that meet it, or, discrete, from one that does to the next."""
    w, keys = ordered(df), keys_of(df)
    d = df.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("dt", F.lead("t").over(w) - F.col("t")).withColumn("next_hit", F.lead("hit").over(w))
    return d.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("hit") if discrete else F.col("hit") & F.col("next_hit"), F.col("dt"))), F.lit(0.0)).alias("duration"))
