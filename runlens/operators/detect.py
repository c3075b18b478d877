"""Extrema, level crossings, violations and transitions, as windows over one partitioning by run and signal."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.samples import KEYS


def keys_of(df: DataFrame) -> list[str]:
    return [*KEYS, "component"] if "component" in df.columns else list(KEYS)


def ordered(df: DataFrame) -> Window:
    return Window.partitionBy(*keys_of(df)).orderBy("idx")


def level_time(ta: Column, tb: Column, xa: Column, xb: Column, level: Column) -> Column:
    """When the line between two samples meets a level, within the bracket."""
    return F.least(F.greatest(ta + (tb - ta) * (level - xa) / F.nullif(xb - xa, F.lit(0.0)), ta), tb)


def global_extrema(df: DataFrame) -> DataFrame:
    """Largest and smallest finite value of each signal; the lowest index on ties. Signals without one are left out."""
    keys, good = keys_of(df), F.col("x").isNotNull()
    top = F.max(F.when(good, F.struct("x", (-F.col("idx")).alias("i"), "t")))
    low = F.min(F.when(good, F.struct("x", F.col("idx").alias("i"), "t")))
    g = df.groupBy(*keys).agg(top.alias("hi"), low.alias("lo")).where("hi is not null")
    return g.select(*keys, (-F.col("hi.i")).alias("max_idx"), F.col("hi.t").alias("max_t"), F.col("hi.x").alias("max_value"), F.col("lo.i").alias("min_idx"), F.col("lo.t").alias("min_t"), F.col("lo.x").alias("min_value"))


def _ulp(x: Column) -> Column:
    """The distance of a positive double from the next one, by powers of two.

    log2 can be one off at a power of two, so the exponent is corrected by comparing.
    """
    e = F.floor(F.log2(x))
    e = F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    return F.when(x > 0, F.pow(F.lit(2.0), e - 52)).otherwise(F.lit(math.ulp(0.0)))


def window_extrema(df: DataFrame, interval: float, origin: float = 0.0) -> DataFrame:
    """Extrema by time bucket. A sample on a bucket boundary also belongs to the bucket before, if that one exists."""
    keys = keys_of(df)
    span = Window.partitionBy(*keys)
    u = (F.col("t") - F.lit(origin)) / F.lit(interval)
    delta = F.lit(8.0) * _ulp(F.greatest(F.max(F.abs(F.col("t"))).over(span), F.lit(0.0)) / F.lit(interval))
    b = df.withColumn("u", u).withColumn("delta", delta).where((F.col("delta") < 0.5) & (F.abs("u") < F.lit(2.0**52)))
    b = b.withColumn("m", F.floor(F.col("u") + F.col("delta")))
    edge = F.abs(F.col("u") - F.rint("u")) <= F.col("delta")
    own = F.struct(F.col("m").alias("bucket"), F.lit(True).alias("own"))
    member = b.withColumn("p", F.explode(F.when(edge, F.array(own, F.struct((F.col("m") - 1).alias("bucket"), F.lit(False).alias("own")))).otherwise(F.array(own)))).select(*keys, "idx", "x", "p.*")
    good, x, i = F.col("x").isNotNull(), F.col("x"), F.col("idx")
    top, low = F.max(F.when(good, F.struct(x.alias("x"), (-i).alias("i")))), F.min(F.when(good, F.struct(x.alias("x"), i.alias("i"))))
    g = member.groupBy(*keys, "bucket").agg(top.alias("hi"), low.alias("lo"), F.max("own").alias("exists")).where("exists and hi is not null")
    return g.select(*keys, "bucket", (-F.col("hi.i")).alias("max_idx"), F.col("hi.x").alias("max_value"), F.col("lo.i").alias("min_idx"), F.col("lo.x").alias("min_value"))


def crossings(df: DataFrame, value: float, edge: str = "both", hysteresis: float = 0.0, debounce: float = 0.0, interpolate: str = "linear") -> DataFrame:
    """All flips of the crossing machine with their verdicts: accepted (lasts long enough), transition (changes the accepted state), reported.

    Columns: keys, crossing (time), edge, index_before, index_after, confirm, gap, duration, accepted, transition, reported,
    pending (of the last flip), discretization_error.
    """
    keys = keys_of(df)
    w = ordered(df)
    v, hi, lo = F.lit(float(value)), F.lit(value + hysteresis / 2), F.lit(value - hysteresis / 2)
    everything = Window.partitionBy(*keys)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("t_end", F.max(F.struct("idx", "t")).over(everything)["t"]).where("x is not null")
    d = d.withColumn("xa", F.lag("x").over(w)).withColumn("ta", F.lag("t").over(w)).withColumn("ia", F.lag("idx").over(w))
    rising, falling = (F.col("xa") < v) & (F.col("x") >= v), (F.col("xa") >= v) & (F.col("x") < v)
    tc = level_time(F.col("ta"), F.col("t"), F.col("xa"), F.col("x"), v) if interpolate == "linear" else F.col("t")
    bracket = F.struct(tc.alias("tc"), F.col("ia").alias("before"), F.col("idx").alias("after"), (F.col("t") - F.col("ta")).alias("disc"))
    d = d.withColumn("up", F.last(F.when(rising, bracket), ignorenulls=True).over(up_to)).withColumn("down", F.last(F.when(falling, bracket), ignorenulls=True).over(up_to))
    mark = F.when(F.col("xa").isNull(), F.col("x") >= v).when(F.col("x") >= hi, True).when((F.col("x") <= lo) & (F.col("x") < v), False)
    d = d.withColumn("state", F.last(mark, ignorenulls=True).over(up_to)).withColumn("initial", F.first(F.col("x") >= v).over(up_to))
    d = d.withColumn("was", F.lag("state").over(w)).where("was is not null and state <> was")
    d = d.withColumn("c", F.when(F.col("state"), F.col("up")).otherwise(F.col("down")))
    d = d.withColumn("next_tc", F.lead("c.tc").over(w))
    d = d.withColumn("duration", F.coalesce(F.col("next_tc"), F.col("t_end")) - F.col("c.tc")).withColumn("accepted", F.col("duration") >= F.lit(float(debounce)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("accepted"), F.col("state")), ignorenulls=True).over(before), F.col("initial"))
    d = d.withColumn("transition", F.col("accepted") & (F.col("state") != held))
    wanted = {"both": F.lit(True), "rising": F.col("state"), "falling": ~F.col("state")}[edge]
    gap = F.col("c.after") - F.col("c.before") > 1
    error = F.col("c.disc") if interpolate == "none" else F.lit(0.0)
    return d.select(
        *keys, F.col("c.tc").alias("crossing"), F.when(F.col("state"), "rising").otherwise("falling").alias("edge"), F.col("c.before").alias("index_before"), F.col("c.after").alias("index_after"),
        F.col("idx").alias("confirm"), "duration", "accepted", "transition", (F.col("transition") & wanted).alias("reported"),
        (F.col("next_tc").isNull() & ~F.col("accepted")).alias("pending"), error.alias("discretization_error"), gap.alias("gap"),
    )


def threshold_crossing(df: DataFrame, value: float, **options) -> DataFrame:
    """The reported crossings."""
    return crossings(df, value, **options).where("reported").drop("accepted", "transition", "reported", "pending")


def crossing_summary(df: DataFrame, value: float, **options) -> DataFrame:
    """Per signal: counts by edge, pending_at_end and gap flips (both before the edge filter)."""
    keys = keys_of(df)
    c = crossings(df, value, **options)
    return c.groupBy(*keys).agg(
        F.count_if("reported").alias("count"), F.count_if(F.col("reported") & (F.col("edge") == "rising")).alias("rising"), F.count_if(F.col("reported") & (F.col("edge") == "falling")).alias("falling"),
        F.max("pending").alias("pending_at_end"), F.count_if(F.col("transition") & F.col("gap")).alias("gap_flips"), F.count(F.lit(1)).alias("flips"),
    )


def islands(df: DataFrame, hit: Column, extra: list[str] = ()) -> DataFrame:
    """Rows of maximal runs of `hit`, with the number of the run and the neighbours' t, x and idx (prev_*, next_*)."""
    w = ordered(df)
    d = df.withColumn("hit", F.coalesce(hit, F.lit(False)))
    for name in ("t", "x", "idx"):
        d = d.withColumn(f"prev_{name}", F.lag(name).over(w)).withColumn(f"next_{name}", F.lead(name).over(w))
    begins = F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))
    return d.withColumn("run_no", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("hit")


def violation(df: DataFrame, above: float | None = None, below: float | None = None, min_duration: float = 0.0) -> DataFrame:
    """Maximal runs beyond a limit. Starts and ends lie where the line meets the limit, unless a run is open or at a gap.

    Columns: keys, start, end, worst_idx, worst_t, worst_value, first_idx, last_idx, open_start, open_end, gap_start, gap_end.
    """
    return violation_places(df, above, below).where(F.col("end") - F.col("start") >= F.lit(float(min_duration))).drop("before_idx", "after_idx")


def violation_places(df: DataFrame, above: float | None = None, below: float | None = None) -> DataFrame:
    """All runs beyond a limit, with the indices of the samples before and after them."""
    keys = keys_of(df)
    limit = F.lit(float(above if above is not None else below))
    hit = F.col("x") > limit if above is not None else F.col("x") < limit
    i = islands(df, hit)
    worst = F.max(F.struct("x", (-F.col("idx")).alias("i"), "t")) if above is not None else F.min(F.struct("x", F.col("idx").alias("i"), "t"))
    ends = [F.struct("idx", "t", "x", *(f"{side}_{c}" for c in ("t", "x", "idx"))) for side in ("prev", "next")]
    g = i.groupBy(*keys, "run_no").agg(F.min(ends[0]).alias("s"), F.max(ends[1]).alias("e"), worst.alias("w"))
    s, e = "s.", "e."
    start = F.when(F.col("s.prev_x").isNull(), F.col("s.t")).otherwise(level_time(F.col("s.prev_t"), F.col("s.t"), F.col("s.prev_x"), F.col("s.x"), limit))
    end = F.when(F.col("e.next_x").isNull(), F.col("e.t")).otherwise(level_time(F.col("e.t"), F.col("e.next_t"), F.col("e.x"), F.col("e.next_x"), limit))
    sign = -1 if above is not None else 1
    return g.select(
        *keys, start.alias("start"), end.alias("end"), F.col("s.prev_idx").alias("before_idx"), F.col("e.next_idx").alias("after_idx"), (F.lit(sign) * F.col("w.i")).alias("worst_idx"), F.col("w.t").alias("worst_t"), F.col("w.x").alias("worst_value"),
        F.col(s + "idx").alias("first_idx"), F.col(e + "idx").alias("last_idx"), F.col("s.prev_idx").isNull().alias("open_start"), F.col("e.next_idx").isNull().alias("open_end"),
        (F.col("s.prev_idx").isNotNull() & F.col("s.prev_x").isNull()).alias("gap_start"), (F.col("e.next_idx").isNotNull() & F.col("e.next_x").isNull()).alias("gap_end"),
    )


def state_transitions(df: DataFrame, column: str = "label") -> DataFrame:
    """First, last and every changed sample. Doubles compare by their text, so that NaN is itself and -0.0 isn't 0.0."""
    keys, w = keys_of(df), ordered(df)
    text = F.col(column).cast("string")
    d = df.withColumn("now", text).withColumn("was", F.lag(text).over(w)).withColumn("n", F.row_number().over(w)).withColumn("last", F.lead("idx").over(w).isNull())
    d = d.withColumn("changed", (F.col("n") > 1) & ~F.col("now").eqNullSafe(F.col("was")))
    return d.where("n = 1 or last or changed").select(*keys, "idx", "t", F.col("now").alias("state"), F.col("was").alias("state_before"), "changed")


def transition_summary(df: DataFrame, column: str = "label") -> DataFrame:
    """Per signal: transitions, the number of distinct values and up to 256 of them in order."""
    keys = keys_of(df)
    changes = state_transitions(df, column).groupBy(*keys).agg(F.count_if("changed").alias("transitions"))
    values = df.groupBy(*keys).agg(F.count_distinct(F.col(column).cast("string")).alias("distinct_count"), F.concat_ws(",", F.slice(F.array_sort(F.collect_set(F.col(column).cast("string"))), 1, 256)).alias("distinct_values"))
    return changes.join(values, keys)


def extent(df: DataFrame) -> DataFrame:
    """First and last sample of each signal."""
    keys = keys_of(df)
    return df.groupBy(*keys).agg(F.min(F.struct("idx", "t")).alias("a"), F.max(F.struct("idx", "t")).alias("z")).select(*keys, F.col("a.idx").alias("first_idx"), F.col("a.t").alias("first_t"), F.col("z.idx").alias("last_idx"), F.col("z.t").alias("last_t"))


def gap_retention(df: DataFrame) -> DataFrame:
    """First and last sample of each run without finite values, and the finite samples next to it."""
    w, fin = ordered(df), F.col("x").isNotNull()
    d = df.withColumn("fin", fin).withColumn("p", F.lag(fin).over(w)).withColumn("n", F.lead(fin).over(w))
    edge = (~F.col("fin") & (F.coalesce("p", F.lit(True)) | F.coalesce("n", F.lit(True)))) | (F.col("fin") & ((F.col("p") == F.lit(False)) | (F.col("n") == F.lit(False))))
    return d.where(edge).select(*keys_of(df), "idx", "t", "fin")


def run_starts(df: DataFrame, hit: Column) -> DataFrame:
    """First sample of each run of true samples; at_start marks one that begins with the signal."""
    w = ordered(df)
    d = df.withColumn("hit", F.coalesce(hit, F.lit(False)))
    d = d.withColumn("was", F.lag("hit").over(w))
    return d.where(F.col("hit") & ~F.coalesce("was", F.lit(False))).select(*keys_of(df), "idx", "t", F.col("was").isNull().alias("at_start"))


_PEAKS = "idx long, value double, prominence double, kind string, left_base long, right_base long"


def _peaks(x: list, first: list, last: list, kind: str) -> list[tuple]:
    """Peaks of merged runs with their bases and places, by two passes with a stack of ever lower runs. None is a wall."""
    n = len(x)

    def bases(order: range) -> list[int]:
        stack, base = [], [0] * n  # (run, lowest run seen since the one above it on the stack)
        for k in order:
            if x[k] is None:
                stack = []
                continue
            low = k
            while stack and x[stack[-1][0]] <= x[k]:
                other = stack.pop()[1]
                low = other if x[other] < x[low] else low
            base[k] = low
            stack.append((k, low))
        return base

    left, right = bases(range(n)), bases(range(n - 1, -1, -1))
    out = []
    for k in range(1, n - 1):
        if x[k] is None or x[k - 1] is None or x[k + 1] is None or not (x[k - 1] < x[k] > x[k + 1]):
            continue
        height = x[k] - max(x[left[k]], x[right[k]])
        sign = 1 if kind == "max" else -1
        out.append(((first[k] + last[k]) // 2, sign * x[k], height, kind, last[left[k]], first[right[k]], k))
    return out


def _spread(peaks: list[tuple], times: list, separation: float) -> list[tuple]:
    """The highest first, the lowest index among equals; a peak stays if none that stays is too near."""
    sign = 1 if peaks[0][3] == "max" else -1
    kept, stays = [], []  # kept: times in order, so that only the two beside a peak can be too near
    for i in sorted(range(len(peaks)), key=lambda i: (-sign * peaks[i][1], peaks[i][0])):
        at = bisect_left(kept, times[i])
        if all(abs(times[i] - o) >= separation for o in kept[max(0, at - 1) : at + 1]):
            kept.insert(at, times[i])
            stays.append(i)
    return [peaks[i] for i in sorted(stays)]


def _extrema_of(d: pa.Table, prominence: float, separation: float, kinds: tuple[str, ...]) -> tuple[list[tuple], list[int]]:
    """Peaks of the whole signals of a table in order, and a row of the signal of each. A wall parts one signal from the next."""
    idx, t, x = (d.column(c).to_numpy() for c in ("idx", "t", "x"))
    begins = d.column("before").is_null().to_numpy()
    same = np.zeros(len(idx), bool)
    same[1:] = (x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))
    start = np.flatnonzero(begins | ~same)  # where runs of equal values begin
    stop = np.append(start[1:], len(idx))
    signal = np.cumsum(begins)[start]
    place = np.arange(len(start)) + signal
    first, last, row, value = (np.zeros(place[-1] + 1, k) for k in (idx.dtype, idx.dtype, int, float))
    first[place], last[place], row[place] = idx[start], idx[stop - 1], start
    value[:] = np.nan
    value[place] = x[start]
    of = dict(zip(place.tolist(), zip(start.tolist(), stop.tolist(), signal.tolist())))
    walls, first, last, row, found = np.flatnonzero(np.isnan(value)).tolist(), first.tolist(), last.tolist(), row.tolist(), []
    for kind in kinds:
        y = (value if kind == "max" else -value).tolist()
        for k in walls:
            y[k] = None
        peaks = [p for p in _peaks(y, first, last, kind) if p[2] >= prominence]
        if separation:
            by = {}
            for p in peaks:
                a, z, signal_ = of[p[-1]]
                i = a + int(np.searchsorted(idx[a:z], p[0]))
                if i < z and idx[i] == p[0]:  # the middle of a run of equal values may not be among the samples
                    by.setdefault(signal_, []).append((p, float(t[i])))
            peaks = [p for pairs in by.values() for p in _spread([q for q, _ in pairs], [at for _, at in pairs], separation)]
        found += peaks
    return [p[:-1] for p in found], [row[p[-1]] for p in found]


def local_extrema(df: DataFrame, prominence: float, separation: float = 0.0, kind: str = "both") -> DataFrame:
    """Peaks by prominence, then greedily by separation, with monotonic stacks: linear in the samples.

    One pass of Arrow batches over the signals in order, as the window leaves them; many signals share a batch, and one signal
    may take several. Columns: keys, idx, value, prominence, kind, left_base, right_base.
    """
    keys = keys_of(df)
    kinds = ("max", "min") if kind == "both" else (kind,)
    types = dict(df.dtypes)

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(b.num_rows for b in held):
            return
        d = pa.Table.from_batches(held).combine_chunks()
        found, rows = _extrema_of(d, prominence, separation, kinds)
        if found:
            own = d.select(keys).take(pa.array(rows, pa.int64())).combine_chunks()
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(own.column(k).chunk(0) for k in keys), *columns], [*keys, *(c.split()[0] for c in _PEAKS.split(", "))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # batches since the last signal began
        for b in batches:
            begins = np.flatnonzero(b.column("before").is_null().to_numpy(zero_copy_only=False))
            if len(begins):
                yield from told([*held, b.slice(0, int(begins[-1]))])
                held, b = [], b.slice(int(begins[-1]))
            held.append(b)
        yield from told(held)

    # before: null where a signal begins; the window also puts signals whole and in order into the tasks
    d = df.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.lag("idx").over(ordered(df)).alias("before"))
    return d.mapInArrow(find, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", " + _PEAKS)
