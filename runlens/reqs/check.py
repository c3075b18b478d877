"""Verdicts of requirements over all runs at once.

All requirements go through one plan over the wide frame of the runs (run_id, idx, t, signals, `e_<event>` arrays,
parameters). Each sample is claimed by the first case whose condition holds, and its excess over the limit becomes a track:
a row for each sample and requirement, made behind the one exchange by run. Violations are islands of a track, and everything
ends in one row for each run and requirement. Numbers, times of conditions and events take one aggregate by run for all of
them. So the number of exchanges doesn't grow with the number of requirements. A requirement that can't be bound is an `error`
row for each run and stops no other.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.expr import Compiler, ExprError, Node, Scope
from runlens.functions.units import UnitError
from runlens.operators.detect import level_time
from runlens.reqs.limits import Cells, Limit, LimitError, Side
from runlens.reqs.table import AGGREGATE_KINDS, Requirement

VERDICTS = ("fail", "error", "warn", "pass", "not_applicable")  # the worst first
RESULT = "run_id, id string, kind string, verdict string, reason string, value double, limit double, margin double, margin_pct double, at double, case string, runs long, violating_time double, tolerated long, first_violation double, active_time double, gap_time double"

_TYPES = dict(x.rsplit(" ", 1) for x in RESULT.split(", ")[1:])
_CLOCK = ("run_id", "idx", "t", "before_ AS pt", "after_ AS nt")
_ROW = "struct<" + ", ".join(f"{n}: {t}" for n, t in _TYPES.items()) + ">"


@dataclass
class Rules:
    """What gaps, short violations, missing events and overlapping cases count as: note, warn or fail."""

    on_gap: str = "warn"
    on_tolerated: str = "pass"
    on_missing_event: str = "warn"
    on_case_overlap: str = "first"
    tolerance: str = "0 s"
    margin: str | None = None
    pending: tuple[str, ...] = ()  # events with a column p_<name>: not confirmed when the run ended


@dataclass
class Bound:
    """A case with its columns."""

    label: str
    when: Column | None
    applies: Column | None
    kind: str
    lower: Column | None = None
    upper: Column | None = None
    strict_low: bool = False
    strict_up: bool = False
    tol_s: float = 0.0
    tol_n: int = 0
    margin_abs: float | None = None
    margin_rel: float | None = None
    count: int | None = None


@dataclass
class Plan:
    req: Requirement
    kind: str
    compiler: Compiler
    check: Node | None
    cases: list[Bound] = field(default_factory=list)


class Checker:
    def __init__(self, frame: DataFrame, scope: Scope, rules: Rules | None = None):
        self.frame, self.scope, self.rules = frame, scope, rules or Rules()
        self.cells = Cells(scope.units)

    # -- binding
    def bind(self, req: Requirement, number: int = 0) -> Plan:
        """The columns of a requirement; number: keeps its window columns apart from those of others in one frame."""
        c = Compiler(self.scope, f"{number}_")
        name = req.check.partition("#")[0].strip("'\" ")
        if req.kind in (None, "event") and name in self.scope.events:
            return Plan(req, "event", c, None, [self._case(k, c, None, req, "event") for k in req.cases])
        text = req.check
        if req.kind in AGGREGATE_KINDS and not text.startswith(f"{req.kind}("):
            text = f"{req.kind}({text})"
        when = [c.condition(k.when).column if k.when else None for k in req.cases]
        check = c.compile(text, when[0])
        kind = self._kind(req, check)
        plan = Plan(req, kind, c, check)
        for i, k in enumerate(req.cases):
            own = c.compile(text, when[i]) if kind == "value" and i else check
            b = self._case(k, c, own, req, kind)
            b.when = when[i]
            b.value = own
            plan.cases.append(b)
        return plan

    def _kind(self, req: Requirement, check: Node) -> str:
        has_limit = any(k.limit or k.lower or k.upper for k in req.cases)
        if req.kind == "duration" or (req.kind is None and check.kind == "condition" and has_limit):
            return "duration"
        if check.kind == "condition":
            if req.kind not in (None, "assert"):
                raise ExprError(f"a condition can't be checked as {req.kind}")
            return "assert"
        if req.kind in AGGREGATE_KINDS or req.kind == "value" or not check.series:
            return "value"
        return "bound"

    def _case(self, k, c: Compiler, check: Node | None, req: Requirement, kind: str) -> Bound:
        unit = "s" if kind in ("duration", "event") else (check.unit if check is not None and check.unit not in (None, "?") else None)
        limit = self.cells.limit(k.limit, req.unit) or self.cells.columns(k.lower, k.upper, req.unit)
        if limit is None and kind in ("bound", "value", "duration"):
            raise LimitError(f"{req.id} has no limit")
        applies = c.condition(self._params(k.applies_to)).column if k.applies_to else None
        b = Bound(k.label, None, applies, "none")
        if limit is not None:
            b.kind, b.lower, b.upper, b.strict_low, b.strict_up = self._sides(limit, c, req, unit)
        b.tol_s, b.tol_n = self.cells.tolerance(k.tolerance if k.tolerance is not None else self.rules.tolerance)
        q, b.margin_rel = self.cells.margin(k.margin if k.margin is not None else self.rules.margin, req.unit)
        b.margin_abs = None if q is None else self._number(q, unit)
        b.count = self.cells.count(k.count)
        return b

    def _params(self, text: str) -> str:
        """Bare names in Applies to are parameters."""
        import re

        return re.sub(r"(?<![\w.'\"])([A-Za-z_]\w*)(?!\w|\(|['\"])", lambda m: f"param.{m[1]}" if m[1] in self.scope.params else m[1], text)

    def _number(self, q, unit: str | None) -> float:
        return self.scope.units.convert(q.value, q.unit, unit) if q.unit and unit and q.unit != unit else q.value

    def _side(self, side: Side | None, c: Compiler, unit: str | None) -> Column | None:
        if side is None:
            return None
        if side.quantity is not None:
            return F.lit(self._number(side.quantity, unit))
        n = c.compile(side.expr)
        column = n.column.try_cast("double") if n.kind == "parameter" else n.column
        return column * F.lit(self.scope.units.factor(n.unit, unit)[0]) if n.unit and unit and n.unit not in ("?", unit) else column

    def _sides(self, limit: Limit, c: Compiler, req: Requirement, unit: str | None) -> tuple:
        kind, low, up = limit.kind, limit.lower, limit.upper
        if kind == "bare":  # the Type column says which end; an upper limit without it
            kind = "lower" if req.kind == "lower" else "upper"
            low, up = (up, None) if kind == "lower" else (None, up)
        if req.kind in ("upper", "lower") and kind in ("upper", "lower") and kind != req.kind:
            raise LimitError(f"{req.id}: a {req.kind} limit can't be written {limit.text!r}")
        return kind, self._side(low, c, unit), self._side(up, c, unit), low is not None and not low.inclusive, up is not None and not up.inclusive

    # -- evaluation
    def one(self, req: Requirement) -> DataFrame:
        return self.check([req])

    def check(self, reqs: list[Requirement]) -> DataFrame:
        """A row for each run and requirement, in the columns of RESULT."""
        plans, rows = [], []
        for i, req in enumerate(reqs):
            try:
                plans.append(self.bind(req, i))
            except (ExprError, UnitError, LimitError) as e:
                rows.append(self._row(req.id, kind=F.lit(req.kind or ""), verdict=F.lit("error"), reason=F.lit(str(e))))
        of = lambda *kinds: [p for p in plans if p.kind in kinds]
        out = []
        if of("bound", "assert"):
            out.append(self._series(of("bound", "assert")))
        values, durations = of("value"), of("duration")
        runs = self._runs(values)
        if durations:
            runs = runs.join(self._durations(durations), "run_id", "left")
        rows += [self._value(p, i) for i, p in enumerate(values)]
        rows += [self._duration(p, i) for i, p in enumerate(durations)]
        rows += [self._event(p) for p in of("event")]
        if rows or not out:
            out.append(runs.select("run_id", F.inline(F.array(*rows).cast(f"array<{_ROW}>"))))
        return reduce(DataFrame.unionByName, out)

    @staticmethod
    def _row(id_: str, **values: Column) -> Column:
        """A result without its run, as a struct."""
        return F.struct(*[(F.lit(id_) if n == "id" else values.get(n, F.lit(None))).cast(t).alias(n) for n, t in _TYPES.items()])

    def claims(self, plan: Plan) -> tuple[Column, Column]:
        """The case of a sample, the first one that holds; and how many hold."""
        which, held = F.lit(None).cast("int"), F.lit(0)
        for i in reversed(range(len(plan.cases))):
            b = plan.cases[i]
            on = F.coalesce(b.when if b.when is not None else F.lit(True), F.lit(False)) & F.coalesce(b.applies if b.applies is not None else F.lit(True), F.lit(False))
            which, held = F.when(on, F.lit(i)).otherwise(which), held + on.cast("int")
        return which, held

    @staticmethod
    def _pick(plan: Plan, claim: str, value) -> Column:
        """A column or number of the claiming case."""
        out = F.lit(None)
        for i, b in enumerate(plan.cases):
            v = value(b)
            out = F.when(F.col(claim) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
        return out

    def _clock(self, plans: list[Plan]) -> DataFrame:
        """The frame with the window columns of the plans and the times before and after each sample: one exchange by run."""
        d, w = self.frame, Window.partitionBy("run_id").orderBy("idx")
        for p in plans:
            d = p.compiler.prepare(d)
        return d.withColumn("before_", F.lag("t").over(w)).withColumn("after_", F.lead("t").over(w))

    @staticmethod
    def _unknown(plan: Plan) -> Column:
        return reduce(lambda a, b: a | b, [b.when.isNull() for b in plan.cases if b.when is not None], F.lit(False))

    def tracks(self, plans: list[Plan]) -> DataFrame:
        """A row for each sample and plan: req, its claim, excess e and whether it violates; null without a claim or a value.

        part 1 are the rows of the warning margins, for the plans that have some.
        """
        d = self._clock(plans)
        first, second = {}, {}
        for i, p in enumerate(plans):
            first[f"claim{i}_"], first[f"held{i}_"] = self.claims(p)
            x = p.check.column
            if p.kind == "assert":
                first[f"x{i}_"] = x
            else:
                first[f"x{i}_"] = F.when(x.isNotNull() & ~F.isnan(x), x).cast("double")
                second[f"u{i}_"], second[f"l{i}_"] = (self._pick(p, f"claim{i}_", end).cast("double") for end in (lambda b: b.upper, lambda b: b.lower))
        d = d.withColumns(first)
        d = d.withColumns(second) if second else d
        out = [t for i, p in enumerate(plans) for t in self._track(p, i)]
        return d.select(*map(F.expr, _CLOCK), F.inline(F.array(*out)))

    def _track(self, p: Plan, i: int) -> list[Column]:
        claim, x = f"claim{i}_", F.col(f"x{i}_")
        none, pick = F.lit(None).cast("double"), lambda value: self._pick(p, claim, value)

        def row(part: int, e: Column, hit: Column, value: Column = none, bound: Column = none, unknown: Column = F.lit(False)) -> Column:
            return F.struct(
                F.lit(i).alias("req"), F.lit(part).alias("part"), F.col(claim).alias("claim"), F.col(f"held{i}_").alias("held"), unknown.alias("unknown"), F.lit(p.check.discrete).alias("discrete"),
                x.isNotNull().alias("fin"), value.alias("x"), bound.alias("bound"), e.alias("e"), F.coalesce(hit, F.lit(False)).alias("viol"),
                pick(lambda b: float(b.tol_s)).cast("double").alias("tol_s"), pick(lambda b: int(b.tol_n)).cast("long").alias("tol_n"),
            )

        if p.kind == "assert":
            e = F.when(F.col(claim).isNotNull() & x.isNotNull(), F.when(x, F.lit(-1.0)).otherwise(1.0))
            return [row(0, e, e > 0, unknown=self._unknown(p))]
        u, low = F.col(f"u{i}_"), F.col(f"l{i}_")
        eu, el = x - u, low - x
        viol = (eu > 0) | (el > 0) | (pick(lambda b: b.strict_up) & (eu == 0)) | (pick(lambda b: b.strict_low) & (el == 0))
        bound = F.when(el.isNull() | (eu >= el), u).otherwise(low)
        out = [row(0, F.greatest(eu, el), viol, x, bound)]
        if any(b.margin_abs is not None or b.margin_rel is not None for b in p.cases):
            margin = lambda c: pick(lambda b: F.lit(b.margin_abs) if b.margin_abs is not None else F.abs(c) * b.margin_rel if b.margin_rel is not None else F.lit(None)).cast("double")
            we = F.greatest(eu + margin(u), el + margin(low))
            out.append(row(1, we, we > 0, x, bound))
        return out

    def excess(self, plan: Plan) -> DataFrame:
        """The track of one plan, without its warnings."""
        return self.tracks([plan]).where("part = 0")

    @staticmethod
    def _islands(d: DataFrame) -> DataFrame:
        """Tracks with the number of their island (0 outside) and the times s_ and z_ at which one would start and end here."""
        w = Window.partitionBy("run_id", "req", "part").orderBy("idx")
        d = d.withColumn("pe", F.lag("e").over(w)).withColumn("ne", F.lead("e").over(w)).withColumn("was", F.coalesce(F.lag("viol").over(w), F.lit(False)))
        begun = F.sum((F.col("viol") & ~F.col("was")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        zero = F.lit(0.0)
        start = F.when(F.col("discrete") | F.col("pe").isNull(), F.col("t")).otherwise(level_time(F.col("pt"), F.col("t"), F.col("pe"), F.col("e"), zero))
        end = F.when(F.col("discrete"), F.coalesce("nt", "t")).when(F.col("ne").isNull(), F.col("t")).otherwise(level_time(F.col("t"), F.col("nt"), F.col("e"), F.col("ne"), zero))
        return d.withColumn("island", F.when(F.col("viol"), begun).otherwise(0)).withColumn("s_", start).withColumn("z_", end)

    @staticmethod
    def _extent(g: DataFrame) -> DataFrame:
        """Length of an island and whether it is short enough to be tolerated."""
        g = g.withColumn("start", F.col("s.s_")).withColumn("end", F.col("z.z_")).withColumn("duration", F.col("end") - F.col("start"))
        short = (F.col("tol_s") > 0) & (F.col("duration") <= F.col("tol_s"))
        return g.withColumn("tolerated", short | (F.col("samples") <= F.col("tol_n"))).drop("s", "z", "tol_s", "tol_n")

    def _ends(self) -> list[Column]:
        return [F.min(F.struct("idx", "s_")).alias("s"), F.max(F.struct("idx", "z_")).alias("z"), F.count(F.lit(1)).alias("samples"), F.min("tol_s").alias("tol_s"), F.min("tol_n").alias("tol_n")]

    def violations(self, d: DataFrame) -> DataFrame:
        """Islands of violating samples of tracks: start, end, samples, worst place, tolerated."""
        worst = F.max(F.struct("e", (-F.col("idx")).alias("i"), "claim", "t", "x", "bound")).alias("w")
        g = self._extent(self._islands(d).where("viol").groupBy("run_id", "req", "part", "island").agg(*self._ends(), worst))
        return g.select("run_id", "req", "part", "start", "end", "samples", F.col("w.claim").alias("claim"), F.col("w.t").alias("worst_t"), F.col("w.x").alias("worst_value"), F.col("w.bound").alias("limit"), F.col("w.e").alias("excess"), "duration", "tolerated")

    def _series(self, plans: list[Plan]) -> DataFrame:
        w = Window.partitionBy("run_id", "req", "part").orderBy("idx")
        claimed, unknown = F.col("claim").isNotNull(), F.col("unknown")
        d = self._islands(self.tracks(plans)).withColumn("claimed", claimed).withColumn("region", claimed | unknown)
        d = d.withColumn("bad", (claimed & ~F.col("fin")) | (unknown & ~claimed)).withColumn("dt", F.col("nt") - F.col("t"))
        for name in ("bad", "region", "claimed", "held"):
            d = d.withColumn(f"next_{name}", F.lead(name).over(w))
        usable = F.col("claimed") & F.col("fin")
        time = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("dt"))), F.lit(0.0))
        # samples outside islands are the group 0 of their track; what belongs to the whole track is added up over its groups
        g = d.groupBy("run_id", "req", "part", "island").agg(
            *self._ends(), F.max(F.when(usable & F.col("e").isNotNull(), F.struct("e", (-F.col("idx")).alias("i"), "x", "bound", "t", "claim"))).alias("w"),
            F.count_if(usable).alias("usable"), F.count_if("claimed").alias("claims"), time(F.col("claimed") & (F.col("discrete") | F.col("next_claimed"))).alias("active_time"),
            time((F.col("bad") | F.col("next_bad")) & F.col("region") & F.col("next_region")).alias("gap_time"), time((F.col("held") > 1) & (F.col("next_held") > 1)).alias("overlap_time"),
        )
        g = self._extent(g)
        own, hit = F.col("part") == 0, F.col("island") > 0
        counted = own & hit & ~F.col("tolerated")
        total = lambda c: F.sum(F.when(own, F.col(c))).alias(c)
        out = g.groupBy("run_id", "req").agg(
            F.max(F.when(own, F.col("w"))).alias("w"), *[total(c) for c in ("usable", "claims", "active_time", "gap_time", "overlap_time")], F.count_if(counted).alias("runs"),
            F.coalesce(F.sum(F.when(counted, F.col("duration"))), F.lit(0.0)).alias("violating_time"), F.count_if(own & hit & F.col("tolerated")).alias("tolerated"),
            F.min(F.when(counted, F.col("start"))).alias("first_violation"), F.count_if((F.col("part") == 1) & hit & ~F.col("tolerated")).alias("warned"),
        )
        known = F.array(*[F.struct(F.lit(p.req.id).alias("id"), F.lit(p.kind).alias("kind"), F.array(*[F.lit(b.label or str(i + 1)) for i, b in enumerate(p.cases)]).alias("labels")) for p in plans])
        out = out.withColumn("known", F.get(known, F.col("req")))
        gap, rules, never = F.col("gap_time") > 0, self.rules, F.lit(False)
        fail = (F.col("runs") > 0) | (gap if rules.on_gap == "fail" else never)
        warn = (F.col("warned") > 0) | (gap if rules.on_gap == "warn" else never) | (F.col("tolerated") > 0 if rules.on_tolerated == "warn" else never)
        error = F.col("overlap_time") > 0 if rules.on_case_overlap == "error" else never
        none, is_assert = F.col("usable") == 0, F.col("known.kind") == "assert"
        verdict = F.when(error & ~fail, "error").when(none, "not_applicable").when(fail, "fail").when(warn, "warn").otherwise("pass")
        exceeded = F.when(is_assert, "condition failed").otherwise("limit exceeded")
        reason = F.when(none & (F.col("claims") == 0), "the condition never holds").when(none, "no data while the condition holds").when(F.col("runs") > 0, exceeded).when(gap & (verdict != "pass"), "data gap").when(F.col("warned") > 0, "inside the warning margin")
        margin = F.when(~is_assert, F.when(F.col("w.e") == 0, F.lit(0.0)).otherwise(-F.col("w.e")))
        columns = {
            "id": F.col("known.id"), "kind": F.col("known.kind"), "verdict": verdict, "reason": reason, "value": F.col("w.x"), "limit": F.col("w.bound"), "margin": margin, "margin_pct": margin / F.nullif(F.abs(F.col("w.bound")), F.lit(0.0)),
            "at": F.when(~none, F.when(is_assert, F.col("first_violation")).otherwise(F.col("w.t"))), "case": F.get(F.col("known.labels"), F.col("w.claim")),
        }
        return out.select("run_id", *[columns.get(n, F.col(n) if n in out.columns else F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items()])

    def compare(self, value: Column, b: Bound) -> tuple[Column, Column, Column]:
        """Verdict, limit and margin of one number against one limit."""
        if b.kind in ("equal", "not_equal"):
            ok = value == b.lower if b.kind == "equal" else value != b.lower
            return F.when(ok, "pass").otherwise("fail"), b.lower.cast("double"), F.lit(None).cast("double")
        ends = []
        for side, bound, strict in (("up", b.upper, b.strict_up), ("low", b.lower, b.strict_low)):
            if bound is None:
                continue
            e = value - bound if side == "up" else bound - value
            m = F.lit(b.margin_abs) if b.margin_abs is not None else F.abs(bound) * b.margin_rel if b.margin_rel is not None else F.lit(None).cast("double")
            ends.append(F.struct(e.alias("e"), F.lit(int(strict)).alias("strict"), bound.cast("double").alias("bound"), m.cast("double").alias("m")))
        top = F.array_max(F.array(*ends))
        e = top["e"]
        fail = (e > 0) | ((e == 0) & (top["strict"] == 1))
        margin = F.when(e == 0, F.lit(0.0)).otherwise(-e)
        return F.when(fail, "fail").when(e + top["m"] > 0, "warn").otherwise("pass"), top["bound"], margin

    def _runs(self, values: list[Plan]) -> DataFrame:
        """A row for each run: parameters, events, and the numbers v<plan>_<case> of the plans."""
        d = self.frame
        for p in values:
            d = p.compiler.prepare(d)
        keep = list(dict.fromkeys(c for c in self.frame.columns if c.startswith(("e_", "p_")) or c in self.scope.params.values()))
        numbers = {f"v{i}_{j}": b.value.column for i, p in enumerate(values) for j, b in enumerate(p.cases)}
        g = d.select("run_id", *keep, *[v.alias(n) for n, v in numbers.items()]).groupBy("run_id")
        kept = [F.first(c, ignorenulls=True).alias(c) for c in (*keep, *numbers)]
        return g.agg(*kept) if kept else g.agg(F.count(F.lit(1)).alias("samples_"))

    def _best(self, plan: Plan, rows: list[Column], **more: Column) -> Column:
        """One headline for each run from the cases: failing ones first, then the least margin."""
        best = F.array_min(F.array(*rows))
        got = {n: best[n] for n in ("verdict", "value", "limit", "margin")} | {"margin_pct": best["margin"] / F.nullif(F.abs(best["limit"]), F.lit(0.0)), "case": F.nullif(best["case"], F.lit(""))}
        return self._row(plan.req.id, kind=F.lit(plan.kind), **got | more)

    @staticmethod
    def _ranked(b: Bound, verdict: Column, value: Column, bound: Column, margin: Column) -> Column:
        rank = F.when(verdict == "fail", 0).when(verdict == "warn", 2).when(verdict == "pass", 3).otherwise(4)
        return F.struct(rank.alias("rank"), F.coalesce(margin, F.lit(float("inf"))).alias("least"), verdict.alias("verdict"), value.alias("value"), bound.alias("limit"), margin.alias("margin"), F.lit(b.label).alias("case"))

    @staticmethod
    def _applies(b: Bound) -> Column:
        return F.coalesce(b.applies, F.lit(False)) if b.applies is not None else F.lit(True)

    def _numbers(self, plan: Plan, values: list[Column], **more: Column) -> Column:
        rows = []
        for b, value in zip(plan.cases, values):
            verdict, bound, margin = self.compare(value, b)
            applies = self._applies(b)
            rows.append(self._ranked(b, F.when(~applies | value.isNull(), "not_applicable").otherwise(verdict), F.when(applies, value), bound, margin))
        return self._best(plan, rows, **more)

    def _value(self, plan: Plan, i: int) -> Column:
        return self._numbers(plan, [F.when(F.isnan(f"v{i}_{j}"), None).otherwise(F.col(f"v{i}_{j}")) for j in range(len(plan.cases))])

    def _durations(self, plans: list[Plan]) -> DataFrame:
        """By run, d<plan>_<case>: time in which a condition holds, and n<plan>_<case>: how often.

        A comparison of series counts from crossing to crossing.
        """
        tracks, out = [], []
        for i, p in enumerate(plans):
            for j, b in enumerate(p.cases):
                active = F.coalesce(b.when, F.lit(False)) if b.when is not None else F.lit(True)
                c = p.check.comparison
                if c and c[1] in ("<", "<=", ">", ">=") and not p.check.discrete:
                    e = c[0].column - c[2].column if c[1] in (">", ">=") else c[2].column - c[0].column
                    hit = e >= 0 if c[1] in (">=", "<=") else e > 0
                else:
                    e = F.when(p.check.column, 1.0).when(~p.check.column, -1.0)
                    hit = e > 0
                tracks.append(F.struct(F.lit(i).alias("req"), F.lit(j).alias("part"), F.when(active, e).cast("double").alias("e"), F.coalesce(active & hit, F.lit(False)).alias("viol"), F.lit(p.check.discrete).alias("discrete")))
                own = (F.col("req") == i) & (F.col("part") == j)
                out += [F.sum(F.when(own, F.col("z.z_") - F.col("s.s_"))).alias(f"d{i}_{j}"), F.count_if(own).alias(f"n{i}_{j}")]
        d = self._clock(plans).select(*map(F.expr, _CLOCK), F.inline(F.array(*tracks)))
        ends = [F.min(F.struct("idx", "s_")).alias("s"), F.max(F.struct("idx", "z_")).alias("z")]
        return self._islands(d).where("viol").groupBy("run_id", "req", "part", "island").agg(*ends).groupBy("run_id").agg(*out)

    def _duration(self, plan: Plan, i: int) -> Column:
        held = lambda j: F.coalesce(F.col(f"d{i}_{j}"), F.lit(0.0))
        return self._numbers(plan, [held(j) for j in range(len(plan.cases))], runs=F.coalesce(F.col(f"n{i}_0"), F.lit(0)), violating_time=held(0))

    def _event(self, plan: Plan) -> Column:
        """Number and time of an event; pending ones warn."""
        name, _, which = plan.req.check.strip("'\" ").partition("#")
        times = F.col(f"e_{name}")
        time = F.get(times, F.size(times) - 1) if which == "last" else F.get(times, int(which or 1) - 1) if which != "all" else F.get(times, 0)
        pending = F.coalesce(F.col(f"p_{name}"), F.lit(False)) if name in self.rules.pending else F.lit(False)
        none, rows = F.lit(None).cast("double"), []
        for b in plan.cases:
            miscount = F.size(times) != (b.count if b.count is not None else 1)
            verdict, bound, margin = self.compare(time, b) if b.kind != "none" else (F.lit("pass"), none, none)
            late = F.when(time.isNull(), F.lit("fail" if b.kind != "none" else "pass")).otherwise(verdict)
            v = F.when(~self._applies(b), "not_applicable").when(miscount | (late == "fail"), "fail").when((late == "warn") | pending, "warn").otherwise("pass")
            rows.append(self._ranked(b, v, time, bound, margin))
        return self._best(plan, rows, value=time, at=time, runs=F.size(times))
