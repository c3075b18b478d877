"""The calls of the engine: check runs against requirements, compile and verify retained samples, look at a source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from runlens.functions.expr import Compiler, ExprError, Scope
from runlens.functions.units import UnitError
from runlens.plans import compile as plan
from runlens.plans import policy as policies
from runlens.reqs import batch, table
from runlens.reqs.check import Checker, Rules
from runlens.reqs.limits import LimitError
from runlens.sources import signals
from runlens.sources.tables import read_table

EXIT_OK, EXIT_FAIL, EXIT_INFEASIBLE, EXIT_USAGE = 0, 1, 2, 3


@dataclass
class Results:
    results: DataFrame
    stats: DataFrame
    runs: DataFrame
    not_covered: list[str]
    issues: list[str]

    def exit_code(self, fail_on: str = "fail") -> int:
        """1 if a run is as bad as fail_on, 3 if there are only errors."""
        found = {r["status"] for r in self.runs.select("status").distinct().collect()}
        if "fail" in found or (fail_on == "warn" and "warn" in found):
            return EXIT_FAIL
        return EXIT_USAGE if found == {"error"} else EXIT_OK


def load(path: str, sheet: str | None = None, **options) -> table.RequirementSet:
    return table.load(read_table(path, sheet), **options)


def lint(reqs: table.RequirementSet, frame: DataFrame, scope: Scope) -> list[str]:
    """What is wrong with requirements before any data is read."""
    checker, out = Checker(frame, scope), list(reqs.issues)
    for r in reqs.requirements:
        try:
            checker.bind(r)
        except (ExprError, UnitError, LimitError) as e:
            out.append(f"{r.id}: {e}")
    return out


def check(frame: DataFrame, reqs: table.RequirementSet, scope: Scope, rules: Rules | None = None) -> Results:
    """Verdicts of all requirements over all runs of a wide frame."""
    results = Checker(frame, scope, rules).check(reqs.requirements)
    return Results(results, batch.requirement_stats(results), batch.run_status(results), reqs.not_covered, reqs.issues)


def compile_runs(samples: DataFrame, policy: str | dict, max_size: object = None, **names) -> tuple[plan.Compiled, policies.Policy]:
    known = [r["signal"] for r in samples.select("signal").distinct().collect()]
    bound = policies.load(policy, sorted(known), max_size=max_size, **names)
    return plan.compile_runs(samples, bound), bound


def verify_runs(samples: DataFrame, compiled: plan.Compiled, policy: policies.Policy) -> DataFrame:
    return plan.verify_runs(samples, compiled, policy)


def inspect(samples: DataFrame) -> DataFrame:
    return signals.catalog(samples)


def init_policy(samples: DataFrame) -> dict:
    """A starter policy for the signals of a source."""
    rows = signals.catalog(samples).groupBy("signal").agg({"kind": "max", "n": "max"}).collect()
    return policies.starter({r["signal"]: r["max(kind)"] for r in rows}, sum(r["max(n)"] for r in rows) * policies.SAMPLE_BYTES)


def derive_policy(reqs: table.RequirementSet, scope: Scope) -> dict:
    """A policy that keeps what requirements speak of: violations of plain bounds, extrema of the other signals checked."""
    checker, hard = Checker.__new__(Checker), {}
    checker.scope, checker.rules = scope, Rules()
    from runlens.reqs.limits import Cells

    checker.cells = Cells(scope.units)
    for r in reqs.requirements:
        node = Compiler(scope).compile(r.check)
        for name in node.names & set(scope.signals):
            ops = hard.setdefault(name, {})
            limits = [checker.cells.limit(c.limit, r.unit) for c in r.cases if c.limit]
            plain = r.check.strip() == name
            for limit in limits:
                for side, key in ((limit.upper if limit else None, "above"), (limit.lower if limit else None, "below")):
                    if plain and side is not None and side.quantity is not None and limit.kind != "bare":
                        ops.setdefault("violation", []).append({key: checker._number(side.quantity, scope.signals[name].unit)})
            if scope.signals[name].kind == "text":
                ops["state_transitions"] = {}
            elif "violation" not in ops:
                ops["global_extrema"] = {}
    return {"version": 1, "hard": hard}
