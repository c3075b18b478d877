"""Fidelity policies: documents that say what of a run must be kept, checked and put in canonical form on the driver.

    version: 1
    hard: {signal: {operator: parameters or a list of them}}
    events: {name: {signal, falls_below | rises_above | equals, hysteresis, debounce, occurrence, expect, keep}}
    sync: [{members: [...], propagate: [...]}]
    soft: [{match: pattern, importance: high | medium | low | none, max_samples}]
    budget: {max_size}
"""

from __future__ import annotations

import difflib
import fnmatch
import hashlib
import json
from dataclasses import dataclass, field

from runlens.functions.units import UnitError, Units

#: Parameters of operators with their kinds and defaults (`...`: required); weights and caps of importance.
OPERATORS: dict[str, dict[str, tuple[str, object]]] = {
    "global_extrema": {}, "window_extrema": {"interval": ("duration", ...), "origin": ("signed duration", 0.0)}, "local_extrema": {"prominence": ("delta", ...), "separation": ("duration", 0.0), "kind": (("both", "max", "min"), "both")},
    "threshold_crossing": {"value": ("value", ...), "edge": (("both", "rising", "falling"), "both"), "hysteresis": ("delta", 0.0), "debounce": ("duration", 0.0), "tolerance": ("duration", 0.0), "interpolate": (("linear", "none"), "linear")},
    "violation": {"above": ("value", None), "below": ("value", None), "min_duration": ("duration", 0.0)}, "state_transitions": {},
}
EVENT = {"falls_below": ("value", None), "rises_above": ("value", None), "equals": ("label", None), "hysteresis": ("delta", 0.0), "debounce": ("duration", 0.0), "occurrence": (("first", "last", "all"), "first"), "expect": ("count", None), "keep": ("keep", None), "signal": ("name", ...)}
IMPORTANCE = {"high": (4.0, 16384), "medium": (2.0, 4096), "low": (1.0, 1024), "none": (0.0, 0)}
TOP = ("version", "name", "hard", "events", "sync", "soft", "budget", "include", "exclude", "on_not_applicable")
SIZES = {"B": 1, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}
MOST_ISSUES = 50
SAMPLE_BYTES = 24  # of a retained sample: time, value, index


@dataclass(frozen=True)
class Issue:
    path: str
    message: str
    line: int | None = None


class PolicyError(ValueError):
    def __init__(self, issues: list[Issue]):
        self.issues = issues
        super().__init__("; ".join(f"{i.path}: {i.message}" for i in issues[:5]))


@dataclass
class Hard:
    id: str
    signal: str
    op: str
    params: dict


@dataclass
class Event:
    name: str
    signal: str
    params: dict


@dataclass
class Policy:
    hard: list[Hard]
    events: list[Event]
    sync: list[dict]
    soft: dict[str, tuple[float, int]]
    max_size: int | None
    data: dict
    lines: dict[str, int] = field(default_factory=dict)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(canonical(self.data)).hexdigest()


def parse(text: str) -> tuple[dict, dict[str, int]]:
    """A YAML or JSON document and the line of every key. The same key twice in one mapping is an error."""
    import yaml

    lines: dict[str, int] = {}

    def build(node, path: str):
        if isinstance(node, yaml.MappingNode):
            out: dict = {}
            for k, v in node.value:
                key, at = k.value, f"{path}.{k.value}" if path else k.value
                if key in out:
                    raise PolicyError([Issue(at, "the key stands there twice", k.start_mark.line + 1)])
                lines[at] = k.start_mark.line + 1
                out[key] = build(v, at)
            return out
        if isinstance(node, yaml.SequenceNode):
            return [build(v, f"{path}[{i}]") for i, v in enumerate(node.value)]
        return loader.construct_object(node)

    loader = yaml.SafeLoader(text)
    try:
        node = loader.get_single_node()
        return (build(node, "") if node is not None else {}), lines
    except yaml.YAMLError as e:
        raise PolicyError([Issue("", f"cannot read the document: {e}")]) from None
    finally:
        loader.dispose()


def size(text: object) -> int:
    """Bytes of `64 KiB` or a number."""
    if isinstance(text, (int, float)):
        return int(text)
    digits = str(text).strip()
    for unit in sorted(SIZES, key=len, reverse=True):
        if digits.endswith(unit):
            return int(float(digits.removesuffix(unit)) * SIZES[unit])
    raise ValueError(f"cannot read size {text!r}")


class _Reader:
    def __init__(self, lines: dict[str, int], units: Units, signal_units: dict[str, str]):
        self.issues: list[Issue] = []
        self.lines, self.units, self.signal_units = lines, units, signal_units

    def issue(self, path: str, message: str) -> None:
        if len(self.issues) < MOST_ISSUES:
            self.issues.append(Issue(path, message, self.lines.get(path)))

    def known(self, path: str, key: str, names) -> bool:
        if key in names:
            return True
        near = difflib.get_close_matches(str(key), list(names), 1)
        self.issue(path, f"unknown {key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return False

    def params(self, path: str, given: object, table: dict, signal: str | None) -> dict:
        if not isinstance(given, dict):
            self.issue(path, "a mapping is needed")
            return {}
        out = {}
        for key in given:
            self.known(f"{path}.{key}", key, table)
        for key, (kind, default) in table.items():
            if key not in given:
                if default is ...:
                    self.issue(path, f"{key} is missing")
                out[key] = None if default is ... else default
                continue
            out[key] = self.one(f"{path}.{key}", given[key], kind, signal)
        return out

    def one(self, path: str, value: object, kind, signal: str | None) -> object:
        if isinstance(kind, tuple):
            return value if self.known(path, value, kind) else None
        if kind in ("name", "label", "keep"):
            return value
        try:
            if kind == "count":
                if int(value) != value or value < 0:
                    raise UnitError("a count is needed")
                return int(value)
            q = self.units.parse(str(value))
            target = "s" if "duration" in kind else self.signal_units.get(signal) if signal else None
            number = q.value
            if q.unit and target:
                number = self.units.convert(q.value, q.unit, target, difference=kind in ("delta", "duration"))
            if kind in ("delta", "duration") and number < 0:
                raise UnitError("it can't be negative")
            return number
        except (UnitError, TypeError, ValueError) as e:
            self.issue(path, str(e))
            return None


def load(source: str | dict, signals: list[str], signal_units: dict[str, str] | None = None, units: Units | None = None, max_size: object = None) -> Policy:
    """A policy bound to the signals of a run. All issues are told together, with their places."""
    data, lines = parse(source) if isinstance(source, str) else (source, {})
    r = _Reader(lines, units or Units(), signal_units or {})
    for key in data:
        r.known(key, key, TOP)
    if data.get("version", 1) != 1:
        r.issue("version", "only version 1 is known")
    kept = [s for s in signals if any(fnmatch.fnmatchcase(s, p) for p in data.get("include", ["*"])) and not any(fnmatch.fnmatchcase(s, p) for p in data.get("exclude", []))]
    hard, events = [], []
    for name, ops in (data.get("hard") or {}).items():
        if not r.known(f"hard.{name}", name, signals):
            continue
        kept += [name] if name not in kept else []
        for op, spec in (ops or {}).items():
            path = f"hard.{name}.{op}"
            if not r.known(path, op, OPERATORS):
                continue
            many = isinstance(spec, list)
            for i, one in enumerate(spec if many else [spec]):
                at = f"{path}[{i}]" if many else path
                p = r.params(at, one or {}, OPERATORS[op], name)
                if op == "violation" and (p.get("above") is None) == (p.get("below") is None):
                    r.issue(at, "one of above and below is needed")
                hard.append(Hard(at, name, op, p))
    for name, spec in (data.get("events") or {}).items():
        path = f"events.{name}"
        signal = (spec or {}).get("signal") if isinstance(spec, dict) else None
        p = r.params(path, spec, EVENT, signal)
        if sum(p.get(k) is not None for k in ("falls_below", "rises_above", "equals")) != 1:
            r.issue(path, "one trigger of falls_below, rises_above and equals is needed")
        if p.get("equals") is not None and (p.get("hysteresis") or p.get("debounce")):
            r.issue(path, "equals has no hysteresis and no debounce")
        if signal is not None:
            r.known(f"{path}.signal", signal, signals)
        events.append(Event(name, signal, p))
    sync = data.get("sync") or []
    for i, group in enumerate(sync):
        members = list(dict.fromkeys(group.get("members", [])))
        if len(members) < 2:
            r.issue(f"sync[{i}]", "two different members are needed")
        for m in members:
            r.known(f"sync[{i}].members", m, signals)
    soft = {}
    for s in kept:
        rule = next((x for x in data.get("soft") or [] if fnmatch.fnmatchcase(s, x.get("match", "*"))), {})
        importance = rule.get("importance", "medium")
        if r.known("soft", importance, IMPORTANCE):
            weight, cap = IMPORTANCE[importance]
            soft[s] = (weight, int(rule.get("max_samples", cap)))
    limit = max_size if max_size is not None else (data.get("budget") or {}).get("max_size")
    try:
        limit = None if limit is None else size(limit)
    except ValueError as e:
        r.issue("budget.max_size", str(e))
    if r.issues:
        raise PolicyError(r.issues)
    return Policy(hard, events, sync, soft, limit, data, lines)


def canonical(data: dict) -> bytes:
    """The document with defaults filled in and keys in order, for hashes."""
    out = json.loads(json.dumps(data, default=str))
    for ops in (out.get("hard") or {}).values():
        for op, spec in list((ops or {}).items()):
            table = {k: d for k, (_, d) in OPERATORS.get(op, {}).items() if d is not ...}
            fill = lambda s: {**table, **(s or {})}  # noqa: B023, E731
            ops[op] = [fill(s) for s in spec] if isinstance(spec, list) else fill(spec)
    return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def starter(signals: dict[str, str], bytes_of_run: int) -> dict:
    """A policy to begin with: extrema of continuous signals, transitions of discrete ones, a fiftieth of the size."""
    hard = {s: {"state_transitions": {}} if kind == "discrete" else {"global_extrema": {}} for s, kind in signals.items()}
    return {"version": 1, "hard": hard, "budget": {"max_size": min(max(bytes_of_run // 50, 256 << 10), 8 << 20)}}
