"""Sets of retained samples, shape-preserving previews and byte budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators import detect
from runlens.operators.detect import keys_of


def union_roles(*parts: DataFrame) -> DataFrame:
    """Union of sample sets; the role bits of one sample are joined."""
    return reduce(DataFrame.unionByName, parts).groupBy("run_id", "signal", "idx").agg(F.bit_or("roles").alias("roles"))


def ranges(kept: DataFrame) -> DataFrame:
    """Half-open ranges of consecutive indices."""
    keys = keys_of(kept)
    w = Window.partitionBy(*keys).orderBy("idx")
    return kept.withColumn("g", F.col("idx") - F.row_number().over(w)).groupBy(*keys, "g").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop")).drop("g")


def from_ranges(spans: DataFrame) -> DataFrame:
    return spans.withColumn("idx", F.explode(F.sequence(F.col("start"), F.col("stop") - 1))).drop("start", "stop")


def _binned(df: DataFrame, bins) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys_of(df)))
    return df.withColumn("n", n).withColumn("bins", bins).withColumn("bin", F.expr("((idx + 1) * bins - 1) div n"))


def equal_count_bins(df: DataFrame, bins: int) -> DataFrame:
    """Extrema of bins with equal numbers of samples."""
    keys = keys_of(df)
    g = _binned(df, F.lit(bins)).where("x is not null").groupBy(*keys, "bin").agg(F.min(F.struct("x", "idx")).alias("lo"), F.max(F.struct("x", (-F.col("idx")).alias("i"))).alias("hi"))
    return g.select(*keys, "bin", F.col("lo.idx").alias("min_idx"), F.col("lo.x").alias("min_value"), (-F.col("hi.i")).alias("max_idx"), F.col("hi.x").alias("max_value"))


def preview_rank(df: DataFrame, levels: int) -> DataFrame:
    """Samples in the order of their use for a preview: extrema of 1, 2, 4 .. equal-count bins, the widest bins first.

    One aggregation on the bins of all levels; the first place of a sample counts, so a shorter preview begins a longer one.
    """
    keys = keys_of(df)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    each = df.select(*keys, "idx", "x", n.alias("n")).where("x is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    b = each.withColumn("bin", F.expr("((idx + 1) * shiftleft(1L, level) - 1) div n"))
    g = b.groupBy(*keys, "level", "bin").agg(F.min(F.struct("x", "idx")).alias("lo"), F.max(F.struct("x", (-F.col("idx")).alias("i"))).alias("hi"))
    span = (F.col("lo.x") - F.col("hi.x")).alias("s")
    picks = F.array(F.struct(F.lit(0).alias("side"), F.col("lo.idx").alias("idx")), F.struct(F.lit(1).alias("side"), (-F.col("hi.i")).alias("idx")))
    c = g.select(*keys, "level", span, "bin", F.explode(picks).alias("p"))
    f = c.groupBy(*keys, F.col("p.idx").alias("idx")).agg(F.min(F.struct("level", "s", "bin", "p.side")).alias("key"))
    return f.select(*keys, "idx", F.row_number().over(Window.partitionBy(*keys).orderBy("key")).alias("rank"))


def bit_reversed(df: DataFrame) -> DataFrame:
    """The order that fills what no bin has picked: indices by their reversed bits."""
    keys = keys_of(df)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = df.withColumn("w", F.greatest(F.lit(1), F.ceil(F.log2(n)).cast("int")))
    return d.select(*keys, "idx", F.conv(F.reverse(F.lpad(F.bin("idx"), F.col("w"), F.lit("0"))), 2, 10).cast("long").alias("reversed"))


def soft_allocation(ranked: DataFrame, scale: float, weight: float, cap: int) -> DataFrame:
    """The first least(cap, floor(scale * weight)) samples of each signal."""
    return ranked.where(F.col("rank") <= F.least(F.lit(cap), F.floor(F.lit(scale * weight))))


def budget_prefix(ranked: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """The longest beginning of the order whose bytes fit in the budget, in one pass: bytes add up by sample."""
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("bytes").over(w)).where(F.col("used") <= budget).drop("used")


def envelopes(df: DataFrame, bins: int) -> DataFrame:
    """Extrema of equal time bins of each run."""
    keys = keys_of(df)
    span = Window.partitionBy(*keys)
    a, b = F.min("t").over(span), F.max("t").over(span)
    d = df.withColumn("bin", F.least(F.floor((F.col("t") - a) / F.nullif(b - a, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long"))
    return d.groupBy(*keys, "bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def quantise(envelope: DataFrame) -> DataFrame:
    """lo_q, hi_q: envelopes in 254 steps between the least and the greatest value of a signal; null stays null."""
    span = Window.partitionBy(*keys_of(envelope))
    low, high = F.min("lo").over(span), F.max("hi").over(span)
    q = lambda c: F.rint((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)) * 254).cast("int").alias(f"{c}_q")
    return envelope.select("*", q("lo"), q("hi"))


def bands(envelope: DataFrame) -> DataFrame:
    """Across runs, by bin: the least, the 5th, 50th and 95th percentile of the middles, and the greatest."""
    mid = (F.col("lo") + F.col("hi")) / 2
    p = F.percentile(mid, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = envelope.groupBy("bin").agg(F.min("lo").alias("lo"), p.alias("p"), F.max("hi").alias("hi"))
    return g.select("bin", "lo", *(F.round(F.col("p")[i], 9).alias(n) for i, n in enumerate(("p05", "p50", "p95"))), "hi")


def advice(df: DataFrame) -> DataFrame:
    """Median step and range of values, from which looser parameters are proposed."""
    keys = keys_of(df)
    d = df.withColumn("dt", F.col("t") - F.lag("t").over(detect.ordered(df)))
    return d.groupBy(*keys).agg(F.percentile("dt", 0.5).alias("median_step"), (F.max("x") - F.min("x")).alias("value_range"))


def verify_crossings(samples: DataFrame, value: float, **options) -> DataFrame:
    """Detects again on retained samples alone and compares with the claims: claimed, found, and those without a partner."""
    claims = detect.crossings(samples, value, **options)
    points = claims.select("run_id", "signal", F.explode(F.array("index_before", "index_after", "confirm")).alias("idx"))
    ends = detect.extent(samples)
    keep = points.unionByName(ends.select("run_id", "signal", F.explode(F.array("first_idx", "last_idx")).alias("idx"))).unionByName(detect.gap_retention(samples).select("run_id", "signal", "idx")).distinct()
    again = detect.threshold_crossing(samples.join(keep, ["run_id", "signal", "idx"], "left_semi"), value, **options)
    a = claims.select("run_id", F.when(F.col("reported"), F.col("confirm")).alias("confirm"), F.col("crossing").alias("claimed_t"))
    b = again.select("run_id", "confirm", F.col("crossing").alias("found_t"))
    m = a.join(b, ["run_id", "confirm"], "full")
    tolerance = F.abs("claimed_t") * 1e-15 + 1e-9
    odd = F.col("confirm").isNotNull() & ~F.coalesce(F.abs(F.col("claimed_t") - F.col("found_t")) <= tolerance, F.lit(False))
    return m.groupBy("run_id").agg(F.count_if(F.col("claimed_t").isNotNull() & F.col("confirm").isNotNull()).alias("claimed"), F.count("found_t").alias("found"), F.count_if(odd).alias("unmatched"))
