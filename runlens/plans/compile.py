"""Compiles many runs against a policy: what must be kept, then a preview within the byte budget, then proof.

All runs and all signals go through the same plan. Retained samples carry the names of the roles that keep them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators import detect as D
from runlens.operators import events as E
from runlens.operators.resample import reconstruction_error, sync_groups
from runlens.plans.policy import SAMPLE_BYTES, Event, Hard, Policy
from runlens.plans.preview import preview_rank
from runlens.session import shared_dir

QUIET = ("extent", "gap", "sync")  # roles that a sync group doesn't pass on


@dataclass
class Compiled:
    retained: DataFrame  # run_id, signal, idx, role
    evidence: DataFrame  # run_id, signal, requirement, count, status
    budget: DataFrame  # run_id, bytes, hard_bytes, fits


def _mark(df: DataFrame, index: str, role: str) -> DataFrame:
    return df.select("run_id", "signal", F.col(index).cast("long").alias("idx"), F.lit(role).alias("role")).where("idx is not null")


def _count(df: DataFrame, h_id: str, signal: str) -> DataFrame:
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("count")).select("run_id", F.lit(signal).alias("signal"), F.lit(h_id).alias("requirement"), "count")


def hard_samples(samples: DataFrame, h: Hard) -> tuple[list[DataFrame], DataFrame]:
    """Samples that one requirement keeps, and what it found."""
    s, p = samples.where(F.col("signal") == h.signal), h.params
    if h.op == "global_extrema":
        g = D.global_extrema(s)
        return [_mark(g, "max_idx", f"{h.id}#max"), _mark(g, "min_idx", f"{h.id}#min")], _count(g, h.id, h.signal)
    if h.op == "window_extrema":
        g = D.window_extrema(s, p["interval"], p["origin"])
        return [_mark(g, "max_idx", f"{h.id}#max"), _mark(g, "min_idx", f"{h.id}#min")], _count(g, h.id, h.signal)
    if h.op == "local_extrema":
        g = D.local_extrema(s, p["prominence"], p["separation"], p["kind"])
        return [_mark(g, "idx", f"{h.id}#peak"), _mark(g, "left_base", f"{h.id}#base"), _mark(g, "right_base", f"{h.id}#base")], _count(g, h.id, h.signal)
    if h.op == "threshold_crossing":
        c = D.crossings(s, p["value"], edge=p["edge"], hysteresis=p["hysteresis"], debounce=p["debounce"], interpolate=p["interpolate"])
        points = ["index_before", "index_after"] + (["confirm"] if p["hysteresis"] else [])
        return [_mark(c, i, h.id) for i in points], _count(c.where("reported"), h.id, h.signal)
    if h.op == "violation":
        v = D.violation_places(s, **{k: p[k] for k in ("above", "below") if p[k] is not None}).withColumn("long", F.col("end") - F.col("start") >= F.lit(float(p["min_duration"])))
        first, last = F.col("first_idx"), F.col("last_idx")
        edges = [(first - 1, F.col("before_idx") == first - 1), (first, F.lit(True)), (last, F.lit(True)), (last + 1, F.col("after_idx") == last + 1)]
        marks = [F.when(there, F.struct(i.alias("idx"), F.lit(f"{h.id}#edge").alias("role"))) for i, there in edges]
        marks.append(F.when(F.col("long"), F.struct(F.col("worst_idx").alias("idx"), F.lit(f"{h.id}#worst").alias("role"))))
        kept = v.select("run_id", "signal", F.inline(F.array_compact(F.array(*marks))))
        return [kept.select("run_id", "signal", F.col("idx").cast("long").alias("idx"), "role")], _count(v.where("long"), h.id, h.signal)
    t = D.state_transitions(s, "label" if "label" in s.columns else "raw")
    return [_mark(t, "idx", h.id)], _count(t.where("changed"), h.id, h.signal)


def event_samples(samples: DataFrame, e: Event) -> tuple[list[DataFrame], DataFrame]:
    """Brackets of all candidates and the windows around the chosen triggers."""
    s, p = samples.where(F.col("signal") == e.signal), e.params
    role = f"events.{e.name}"
    if p["equals"] is not None:
        hit = F.col("label") == str(p["equals"]) if isinstance(p["equals"], str) else F.col("x") == float(p["equals"])
        starts = D.run_starts(s, hit)
        found = E.equals_event(s, e.name, hit)
        marks = [_mark(starts, "idx", f"{role}#trigger"), _mark(starts.withColumn("idx", F.col("idx") - 1).where("idx >= 0"), "idx", f"{role}#trigger")]
    else:
        value, edge = (p["rises_above"], "rising") if p["rises_above"] is not None else (p["falls_below"], "falling")
        c = D.crossings(s, value, edge=edge, hysteresis=p["hysteresis"], debounce=p["debounce"])
        marks = [_mark(c, i, f"{role}#trigger") for i in ("index_before", "index_after", "confirm")]
        found = E.number(c.where("reported").select("run_id", F.col("crossing").alias("t")), e.name)
    keep = p["keep"] or {}
    listed = samples.where(F.col("signal").isin(list(keep.get("signals", [e.signal]))))
    w = E.windows(listed, E.occurrence(found, p["occurrence"]), float(keep.get("before", 0.0)), float(keep.get("after", 0.0)))
    spans = w.select("run_id", "signal", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    counted = _count(found.withColumn("signal", F.lit(e.signal)), role, e.signal)
    if p["expect"] is not None:
        counted = counted.withColumn("expected", F.lit(p["expect"]).cast("long"))
    return [*marks, _mark(spans, "idx", f"{role}#window")], counted


def _partners(samples: DataFrame, kept: DataFrame, group: dict) -> DataFrame:
    """The times that a sync group propagates, on every member, as sync_groups finds them."""
    members = samples.where(F.col("signal").isin(group["members"]))
    loud = kept.where(~F.col("role").isin(*QUIET)).select("run_id", "signal", "idx").distinct()
    moved = members.join(loud, ["run_id", "signal", "idx"], "left_semi")
    if group.get("propagate"):
        moved = moved.where(F.col("signal").isin(group["propagate"]))
    return sync_groups(members, moved)


def _places(partners: DataFrame) -> DataFrame:
    return partners.select("run_id", "t", "signal", F.explode(F.array("index", "index_before", "index_after")).alias("idx")).where("idx is not null")


def _synchronised(samples: DataFrame, kept: DataFrame, policy: Policy) -> DataFrame:
    """Adds the samples of the sync groups."""
    for group in policy.sync:
        kept = kept.unionByName(_mark(_places(_partners(samples, kept, group)), "idx", "sync")).distinct()
    return kept


def _charged(samples: DataFrame, picks: DataFrame, hard: DataFrame, policy: Policy) -> DataFrame:
    """cost: the samples that sync groups add at the time of a pick, itself included; picks at one time pay for them each."""
    if not policy.sync:
        return picks.withColumn("cost", F.lit(1).cast("long"))
    have = hard.select("run_id", "signal", "idx").distinct()
    added = None
    for group in policy.sync:
        new = _places(_partners(samples, _mark(picks, "idx", "soft"), group)).join(have, ["run_id", "signal", "idx"], "left_anti")
        added = new if added is None else added.unionByName(new)
    owed = added.distinct().groupBy("run_id", "t").agg(F.count(F.lit(1)).alias("owed"))
    timed = picks if "t" in picks.columns else picks.join(samples.select("run_id", "signal", "idx", "t"), ["run_id", "signal", "idx"])
    return timed.join(owed, ["run_id", "t"], "left").withColumn("cost", F.greatest(F.lit(1), F.coalesce("owed", F.lit(1))).cast("long"))


def compile_runs(samples: DataFrame, policy: Policy) -> Compiled:
    """Retained samples, evidence and bytes of every run."""
    used = samples.where(F.col("signal").isin([*policy.soft])) if policy.soft else samples
    ends, gaps = D.extent(used), D.gap_retention(used.where(F.col("signal").isin([h.signal for h in policy.hard]))) if policy.hard else None
    parts, counts = [_mark(ends, "first_idx", "extent"), _mark(ends, "last_idx", "extent")], []
    if gaps is not None:
        parts.append(_mark(gaps, "idx", "gap"))
    for marks, found in [*(hard_samples(samples, h) for h in policy.hard), *(event_samples(samples, e) for e in policy.events)]:
        parts += marks
        counts.append(found)
    hard = _synchronised(samples, reduce(DataFrame.unionByName, parts).distinct(), policy)
    # the preview: the best samples of each signal by weight, as far as the bytes of the run allow
    shown = [name for name, (w, c) in policy.soft.items() if w > 0 and c > 0]  # no rank is asked of the others
    ranked = preview_rank(used.where(F.col("signal").isin(shown)), 10).join(hard.select("run_id", "signal", "idx").distinct(), ["run_id", "signal", "idx"], "left_anti")
    weight, cap = F.lit(0.0), F.lit(0)
    for name, (w, c) in policy.soft.items():
        weight, cap = F.when(F.col("signal") == name, F.lit(w)).otherwise(weight), F.when(F.col("signal") == name, F.lit(c)).otherwise(cap)
    ranked = ranked.where((F.col("rank") <= cap) & (weight > 0)).withColumn("order_", F.col("rank") / weight)
    used_bytes = hard.select("run_id", "signal", "idx").distinct().groupBy("run_id").agg((F.count(F.lit(1)) * SAMPLE_BYTES).alias("hard_bytes"))
    if policy.max_size is not None:
        ranked = _charged(samples, ranked, hard, policy)
        so_far = F.sum("cost").over(Window.partitionBy("run_id").orderBy("order_", "signal", "idx").rowsBetween(Window.unboundedPreceding, 0)) * SAMPLE_BYTES
        ranked = ranked.withColumn("bytes_", so_far).join(used_bytes, "run_id").where(F.col("bytes_") + F.col("hard_bytes") <= policy.max_size)
    soft = _mark(ranked, "idx", "soft")
    kept = _synchronised(samples, hard.unionByName(soft), policy) if policy.sync else hard.unionByName(soft)
    for i, group in enumerate(policy.sync):
        g = _partners(samples, kept, group)
        counts.append(g.where("status = 'unaligned'").groupBy("run_id").agg(F.count(F.lit(1)).alias("count")).select("run_id", F.lit(",".join(group["members"])).alias("signal"), F.lit(f"sync[{i}]").alias("requirement"), "count"))
    size = kept.select("run_id", "signal", "idx").distinct().groupBy("run_id").agg((F.count(F.lit(1)) * SAMPLE_BYTES).alias("bytes")).join(used_bytes, "run_id")
    fits = F.lit(True) if policy.max_size is None else F.col("hard_bytes") <= policy.max_size
    evidence = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts) if counts else used_bytes.select("run_id").where("false").selectExpr("run_id", "'' signal", "'' requirement", "0L count")
    if "expected" not in evidence.columns:
        evidence = evidence.withColumn("expected", F.lit(None).cast("long"))
    status = F.when(F.col("requirement").startswith("sync") & (F.col("count") > 0), "warn").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("count")), "warn").otherwise("pass")
    return Compiled(kept, evidence.withColumn("status", status), size.withColumn("fits", fits))


def minimum(samples: DataFrame, policy: Policy) -> DataFrame:
    """What each requirement costs by itself: samples and bytes of every run, for a budget that can't be met."""
    parts = [(h.id, hard_samples(samples, h)[0]) for h in policy.hard] + [(f"events.{e.name}", event_samples(samples, e)[0]) for e in policy.events]
    each = [reduce(DataFrame.unionByName, m).select("run_id", "signal", "idx").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("samples")).withColumn("requirement", F.lit(i)) for i, m in parts]
    return reduce(DataFrame.unionByName, each).withColumn("bytes", F.col("samples") * SAMPLE_BYTES)


def _at_once(samples: DataFrame, h: Hard, key: str) -> DataFrame | None:
    """Samples that a requirement keeps, with how far the parameter may be raised until they aren't kept; None where it must be detected again."""
    s, p = samples.where(F.col("signal") == h.signal), h.params
    if h.op == "violation" and key == "min_duration":
        v = D.violation_places(s, **{k: p[k] for k in ("above", "below") if p[k] is not None})
        first, last, always = F.col("first_idx"), F.col("last_idx"), F.lit(float("inf"))
        marks = [F.when(there, F.struct(i.alias("idx"), always.alias("upto"))) for i, there in ((first - 1, F.col("before_idx") == first - 1), (first, F.lit(True)), (last, F.lit(True)), (last + 1, F.col("after_idx") == last + 1))]
        return v.select("run_id", "signal", F.inline(F.array_compact(F.array(*marks, F.struct(F.col("worst_idx").alias("idx"), (F.col("end") - F.col("start")).alias("upto"))))))
    if h.op == "local_extrema" and key == "prominence" and not p["separation"]:
        g = D.local_extrema(s, p["prominence"], kind=p["kind"])
        return g.select("run_id", "signal", F.inline(F.array(*[F.struct(F.col(c).alias("idx"), F.col("prominence").alias("upto")) for c in ("idx", "left_base", "right_base")])))
    return None


def relaxations(samples: DataFrame, policy: Policy, factors: tuple[float, ...] = (2.0, 4.0)) -> DataFrame:
    """What looser parameters would save, measured: each length or height made 2 or 4 times as large, or the requirement dropped.

    Where a sample's own measure says up to which value it is kept, all factors come from one detection.
    """
    out = []
    for h in policy.hard:
        for key in ("interval", "prominence", "hysteresis", "debounce", "min_duration", "separation"):
            if not h.params.get(key):
                continue
            once = _at_once(samples, h, key)
            if once is not None:
                best = once.groupBy("run_id", "signal", "idx").agg(F.max("upto").alias("upto"))
                counts = best.groupBy("run_id").agg(*[F.count_if(F.col("upto") >= F.lit(float(h.params[key] * f))).alias(f"n{i}") for i, f in enumerate(factors)])
                rows = F.array(*[F.struct(F.lit(f"{key} x {f:g}").alias("change"), F.col(f"n{i}").alias("samples")) for i, f in enumerate(factors)])
                out.append(counts.select("run_id", F.lit(h.id).alias("requirement"), F.inline(rows)).where("samples > 0"))
                continue
            for f in factors:
                loose = replace(h, params={**h.params, key: h.params[key] * f})
                n = reduce(DataFrame.unionByName, hard_samples(samples, loose)[0]).select("run_id", "signal", "idx").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"))
                out.append(n.select("run_id", F.lit(h.id).alias("requirement"), F.lit(f"{key} x {f:g}").alias("change"), "samples"))
    if policy.hard:
        dropped = F.array(*[F.struct(F.lit(h.id).alias("requirement"), F.lit("drop").alias("change"), F.lit(0).cast("long").alias("samples")) for h in policy.hard])
        out.append(samples.select("run_id").distinct().select("run_id", F.inline(dropped)))
    return reduce(DataFrame.unionByName, out)


def verify_runs(samples: DataFrame, compiled: Compiled, policy: Policy) -> DataFrame:
    """Checks of every run: run_id, check, ok. Detectors run again on the retained samples alone and must find the same."""
    folder = f"{shared_dir(samples.sparkSession).rstrip('/')}/verify-{uuid.uuid4().hex}"  # what was compiled is read by every check
    compiled.retained.select("run_id", "signal", "idx").distinct().write.parquet(f"{folder}/kept")
    compiled.budget.write.parquet(f"{folder}/budget")
    kept, budget = (samples.sparkSession.read.parquet(f"{folder}/{n}") for n in ("kept", "budget"))
    known = samples.select("run_id", "signal", "idx")
    runs = samples.select("run_id").distinct()
    checks = []

    def add(name: str, bad: DataFrame) -> None:
        n = bad.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
        checks.append(runs.join(n, "run_id", "left").select("run_id", F.lit(name).alias("check"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("ok")))

    add("source.samples", kept.join(known, ["run_id", "signal", "idx"], "left_anti"))
    ends = D.extent(samples.join(kept.select("run_id", "signal").distinct(), ["run_id", "signal"], "left_semi"))
    add("structure.extent", ends.select("run_id", "signal", F.explode(F.array("first_idx", "last_idx")).alias("idx")).join(kept, ["run_id", "signal", "idx"], "left_anti"))
    rest = samples.join(kept, ["run_id", "signal", "idx"], "left_semi")
    for h in policy.hard:
        if h.op == "local_extrema":
            continue  # the reconstruction may show other bumps; the claimed peaks are kept
        want = reduce(DataFrame.unionByName, hard_samples(samples, h)[0]).distinct()
        got = reduce(DataFrame.unionByName, hard_samples(rest, h)[0]).distinct()
        if h.op in ("threshold_crossing", "global_extrema", "window_extrema"):
            add(h.id, want.join(got, ["run_id", "signal", "idx", "role"], "left_anti").unionByName(got.join(want, ["run_id", "signal", "idx", "role"], "left_anti")))
        else:
            add(h.id, want.join(kept, ["run_id", "signal", "idx"], "left_anti"))
    over = budget.where(F.col("bytes") > F.lit(policy.max_size)) if policy.max_size is not None else budget.where("false")
    add("budget.size", over.where("fits"))
    return reduce(DataFrame.unionByName, checks)


def manifest(samples: DataFrame, compiled: Compiled, policy: Policy) -> DataFrame:
    """One row for each run: status, bytes, retained samples, largest reconstruction error, and the policy's hash."""
    worst = compiled.evidence.groupBy("run_id").agg(F.max((F.col("status") == "warn").cast("int")).alias("warned"))
    errors = reconstruction_error(samples, compiled.retained).groupBy("run_id").agg(F.max("max_error").alias("max_error"), F.sum("retained").alias("retained"), F.sum("samples").alias("samples"))
    d = compiled.budget.join(worst, "run_id", "left").join(errors, "run_id", "left")
    status = F.when(~F.col("fits"), "infeasible").when(F.col("warned") == 1, "pass_with_warnings").otherwise("pass")
    return d.select("run_id", status.alias("status"), "bytes", "hard_bytes", "retained", "samples", "max_error", F.lit(policy.sha256).alias("policy_sha256"))
