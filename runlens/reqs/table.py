"""Requirements tables: rows of cells to requirements with ordered cases."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

#: Header texts that name a field, without case, blanks and signs.
HEADERS = {
    "id": ("id", "reqid", "requirementid", "requirement", "identifier", "key", "number", "no", "reqno"), "title": ("title", "name", "summary", "description", "text"), "check": ("check", "signal", "expression", "measure", "parameter", "quantity"),
    "kind": ("type", "kind", "checktype", "limittype"), "limit": ("limit", "threshold", "criterion", "criteria", "value"), "lower": ("min", "minimum", "lower", "lowerlimit", "low", "lsl"), "upper": ("max", "maximum", "upper", "upperlimit", "high", "usl"),
    "unit": ("unit", "units", "uom"), "when": ("when", "condition", "phase", "during", "applieswhen"), "applies_to": ("appliesto", "applicability", "configuration", "config", "variant"), "tolerance": ("tolerance", "persistence", "duration", "debounce"),
    "margin": ("margin", "warnmargin", "warningmargin"), "case": ("case", "subcase"), "count": ("count", "expectedcount", "occurrences"), "severity": ("severity", "criticality", "priority", "category"), "grid": ("grid", "timebase"), "notes": ("notes", "note", "comment", "comments", "remarks", "rationale"),
}
#: Words of the Type column.
KINDS = {
    "upper": ("upper", "upperlimit", "maximumlimit", "maxlimit", "ceiling", "nottoexceed", "notexceed", "le", "<=", "≤"), "lower": ("lower", "lowerlimit", "minimumlimit", "minlimit", "floor", "ge", ">=", "≥"),
    "range": ("range", "band", "within", "between", "rangelimit"), "assert": ("assert", "shallhold", "always", "invariant", "condition", "check"), "duration": ("duration", "timeabove", "totaltime", "time"), "value": ("value", "scalar", "number", "calculated"),
    "event": ("event", "occurs", "eventtime", "timing", "occurrence"), "max": ("max", "maximum", "peak"), "min": ("min", "minimum"), "mean": ("mean", "average", "avg"), "final": ("final", "end", "finalvalue", "last"), "initial": ("initial", "start", "initialvalue", "first"), "rms": ("rms",), "integral": ("integral",),
}
AGGREGATE_KINDS = ("max", "min", "mean", "final", "initial", "rms", "integral")


class TableError(ValueError):
    """A table without what it needs."""


@dataclass
class Case:
    row: int
    label: str = ""
    when: str | None = None
    applies_to: str | None = None
    limit: str | None = None
    lower: str | None = None
    upper: str | None = None
    tolerance: str | None = None
    margin: str | None = None
    count: str | None = None
    severity: str | None = None


@dataclass
class Requirement:
    id: str
    check: str
    kind: str | None = None
    title: str = ""
    unit: str | None = None
    cases: list[Case] = field(default_factory=list)
    passthrough: dict[str, str] = field(default_factory=dict)


@dataclass
class RequirementSet:
    requirements: list[Requirement]
    not_covered: list[str]
    issues: list[str]


def plain(text: object) -> str:
    return re.sub(r"[^a-z0-9<>=≤≥]", "", str(text or "").lower())


def columns_of(header: list[object]) -> dict[str, int]:
    """Field to column; the first header that names a field has it."""
    out: dict[str, int] = {}
    for i, text in enumerate(header):
        for name, words in HEADERS.items():
            if plain(text) in words and name not in out:
                out[name] = i
                break
    return out


def find_header(rows: list[list[object]]) -> int:
    """The first row that names an id and a check."""
    for i, row in enumerate(rows[:50]):
        if {"id", "check"} <= set(columns_of(row)):
            return i
    raise TableError("no header row with an id and a check")


def load(rows: list[list[object]], where: dict[str, str] | None = None, only: list[str] | None = None, passthrough: list[str] = ()) -> RequirementSet:
    """Rows with the same id are ordered cases of one requirement; rows without an id are headings.

    where: header to value, rows must match; only: patterns of ids.
    """
    top = find_header(rows)
    header, at = rows[top], columns_of(rows[top])
    others = {plain(h): i for i, h in enumerate(header)}
    found: dict[str, Requirement] = {}
    not_covered, issues = [], []
    for n, row in enumerate(rows[top + 1 :], top + 2):
        cell = lambda name: (str(row[at[name]]).strip() or None) if name in at and at[name] < len(row) and row[at[name]] is not None else None  # noqa: B023, E731
        rid = cell("id")
        if rid is None:
            continue
        if any(str(row[others[plain(k)]]).strip().lower() != v.lower() for k, v in (where or {}).items() if plain(k) in others):
            continue
        if only and not any(fnmatch.fnmatchcase(rid, p) for p in only):
            continue
        check = cell("check")
        if check is None and rid not in found:
            not_covered.append(rid)
            continue
        kind = None
        if word := cell("kind"):
            kind = next((k for k, words in KINDS.items() if plain(word) in words), None)
            if kind is None:
                issues.append(f"row {n}: unknown type {word!r}")
        req = found.get(rid)
        if req is None:
            extra = {h: str(row[others[plain(h)]]) for h in passthrough if plain(h) in others}
            req = found[rid] = Requirement(rid, check, kind, cell("title") or "", cell("unit"), passthrough=extra)
        elif check not in (None, req.check):
            issues.append(f"row {n}: the cases of {rid} check different things")
        req.cases.append(Case(n, cell("case") or "", *(cell(c) for c in ("when", "applies_to", "limit", "lower", "upper", "tolerance", "margin", "count", "severity"))))
    return RequirementSet(list(found.values()), not_covered, issues)
