"""Mapping documents: what the names of a requirements table stand for in the runs.

    signals: {alias: {path, expr, unit, kind}}      conditions: {name: expression}      units: {symbol: quantity}
    events: {name: {when | signal + falls_below / rises_above / equals | param, hysteresis, debounce}}
    curves: {name: {x, x_unit, y_unit, points, mode, outside}}
    defaults: {tolerance, margin, on_gap, on_tolerated, on_missing_event, on_case_overlap}
"""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.expr import Compiler, ExprError, Scope, Signal
from runlens.functions.units import Units
from runlens.operators import events as E
from runlens.reqs.check import Rules
from runlens.sources.tables import SourceError, read_xlsx, sheets

TOP = ("version", "name", "signals", "conditions", "units", "events", "curves", "defaults", "params", "requirements", "report", "time", "source", "checks")
CONFIG_SHEETS = ("Signals", "Conditions", "Units", "Events", "Defaults")


def merge(low: dict, high: dict) -> dict:
    """Mappings are merged key by key; everything else is replaced."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def override(text: str) -> dict:
    """`defaults.tolerance=1 s` as a document."""
    path, sep, value = text.partition("=")
    if not sep:
        raise SourceError(f"{text!r} sets nothing")
    return reduce(lambda inner, key: {key: inner}, reversed(path.strip().split(".")), value.strip())


def from_workbook(path: str) -> dict:
    """Config sheets: the first column names an entry, the others its fields; two columns are name and value."""
    out: dict = {}
    for sheet in sheets(path):
        if sheet not in CONFIG_SHEETS:
            continue
        header, *rows = read_xlsx(path, sheet)
        for row in rows:
            if row[0] is None:
                continue
            fields = {str(h).strip().lower(): v for h, v in zip(header[1:], row[1:]) if h is not None and v is not None}
            plain = sheet in ("Conditions", "Units", "Defaults")
            out.setdefault(sheet.lower(), {})[str(row[0])] = next(iter(fields.values()), None) if plain else fields
    return out


def layer(*documents: dict, overrides: tuple[str, ...] = ()) -> dict:
    """Documents from the weakest to the strongest, then single settings."""
    out = reduce(merge, [*documents, *map(override, overrides)], {})
    for key in out:
        if key not in TOP:
            near = difflib.get_close_matches(key, TOP, 1)
            raise SourceError(f"unknown {key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return out


def scope_of(doc: dict, frame: DataFrame, params: dict[str, str] | None = None) -> Scope:
    """Names of a mapping over the columns of a wide frame. Columns without a mapping go by their own name."""
    types = dict(frame.dtypes)
    own = {c: Signal(c, kind="text" if t == "string" else "vector" if t.startswith("array") else "number", discrete=t in ("string", "boolean", "int", "bigint")) for c, t in types.items() if c not in ("run_id", "idx", "t") and not c.startswith(("e_", "p_")) and c not in (params or {}).values()}
    signals, aliases = dict(own), {}
    for alias, spec in (doc.get("signals") or {}).items():
        spec = {"path": spec} if isinstance(spec, str) else spec
        if spec.get("expr"):
            text = spec["expr"]
            aliases[alias] = f"as_unit({text}, '{spec['unit']}')" if spec.get("unit") else text
            continue
        column = spec.get("path", alias)
        if column not in own:
            near = difflib.get_close_matches(column, own, 1)
            raise SourceError(f"signals.{alias}: no column {column!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        kind = spec.get("kind")
        signals[alias] = Signal(column, spec.get("unit"), own[column].discrete if kind is None else kind == "discrete", own[column].kind)
    return Scope(signals, aliases, dict(doc.get("conditions") or {}), tuple(doc.get("events") or ()), params or {}, dict(doc.get("curves") or {}), Units(doc.get("units")))


def rules_of(doc: dict) -> Rules:
    given = dict(doc.get("defaults") or {})
    known = ("tolerance", "margin", "on_gap", "on_tolerated", "on_missing_event", "on_case_overlap")
    for key in given:
        if key not in (*known, "grid"):
            raise SourceError(f"defaults.{key} isn't known")
    return Rules(**{k: v for k, v in given.items() if k in known})


def attach_events(frame: DataFrame, doc: dict, scope: Scope) -> DataFrame:
    """The frame with an array of times for each event of the mapping.

    A comparison of numbers is a crossing of their difference through 0, with `>` and `>=` alike; any other condition is a
    crossing of its truth. Either isn't triggered where it holds from the start, `equals` is.
    """
    found = {}
    bare = Scope(scope.signals, scope.aliases, scope.conditions, (), scope.params, scope.curves, scope.units, scope.partition)
    for name, spec in (doc.get("events") or {}).items():
        c = Compiler(bare)
        bounce = scope.units.seconds(str(spec["debounce"])) if spec.get("debounce") else 0.0
        if spec.get("param"):
            times = frame.groupBy("run_id").agg(F.first(F.col(scope.params[spec["param"]]).try_cast("double"), ignorenulls=True).alias("t")).where("t is not null")
            found[name] = E.number(times, name)
            continue
        if spec.get("when"):
            n = c.condition(spec["when"])
            pair = n.comparison
            if pair and pair[1] in ("<", "<=", ">", ">="):
                e = pair[0].column - pair[2].column if pair[1] in (">", ">=") else pair[2].column - pair[0].column
            else:
                e = F.when(n.column, 1.0).when(~n.column, -1.0)
            level, edge = 0.0, "rising"
        else:
            n = c.compile(spec["signal"])
            if "equals" in spec:
                hit = n.column == (str(spec["equals"]) if n.kind == "text" else float(spec["equals"]))
                rows = c.prepare(frame).select("run_id", F.lit(name).alias("signal"), "idx", "t", hit.alias("hit_"))
                found[name] = E.equals_event(rows, name, F.col("hit_"))
                continue
            edge = "rising" if "rises_above" in spec else "falling"
            q = scope.units.parse(str(spec["rises_above" if edge == "rising" else "falls_below"]))
            level = scope.units.convert(q.value, q.unit, n.unit) if q.unit and n.unit else q.value
            e = n.column
        if n.kind == "text":
            raise ExprError(f"events.{name}: a text has no level")
        samples = c.prepare(frame).select("run_id", F.lit(name).alias("signal"), "idx", "t", e.alias("x"))
        band = scope.units.parse(str(spec["hysteresis"])).value if spec.get("hysteresis") else 0.0
        found[name] = E.crossing_event(samples, name, level, edge, band, bounce)
    return E.attach(frame, found)


def context(results: DataFrame, frame: DataFrame, scope: Scope) -> DataFrame:
    """For failing and warning rows: the named conditions that hold at the worst time, and the last event before it."""
    c = Compiler(scope)
    holds = {n: c.condition(n).column for n in scope.conditions}
    d = c.prepare(frame)
    named = F.filter(F.array(*[F.when(h, F.lit(n)) for n, h in holds.items()] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    at = results.where("verdict in ('fail', 'warn') and at is not null").select("run_id", "id", "at")
    met = at.join(d.select("run_id", "idx", "t", named.alias("conditions"), *[f"e_{n}" for n in scope.events]), "run_id").where("t <= at")
    g = met.groupBy("run_id", "id", "at").agg(F.max(F.struct("t", "idx", "conditions", *[f"e_{n}" for n in scope.events])).alias("s")).select("run_id", "id", "at", "s.*")
    if not scope.events:
        return g.select("run_id", "id", "at", "conditions")

    def before(name: str):
        return F.transform(F.filter(F.col(f"e_{name}"), lambda t: t <= F.col("at")), lambda t: F.struct(t.alias("t"), F.lit(name).alias("event")))

    past = F.flatten(F.array(*[before(n) for n in scope.events]))
    return g.withColumn("last", F.array_max(past)).select("run_id", "id", "at", "conditions", F.col("last.event").alias("last_event"), (F.col("at") - F.col("last.t")).alias("since"))
