"""Cells, expressions and verdicts on small runs."""

import pytest

from runlens.functions.expr import Compiler, ExprError, Scope, Signal
from runlens.functions.units import Units, UnitError
from runlens.reqs import table
from runlens.reqs.check import Checker, Rules
from runlens.reqs.limits import Cells, LimitError
from runlens.reqs.table import Case, Requirement

CELLS = Cells()


@pytest.mark.parametrize(
    "text,kind,low,up",
    [("<= 70 kPa", "upper", None, 70), ("max 70 kPa", "upper", None, 70), ("at least 2 kN", "lower", 2, None), ("[-7, 7] deg", "range", -7, 7), ("99 .. 102 s", "range", 99, 102), ("99–102 s", "range", 99, 102), ("between 2 and 3 kN", "range", 2, 3), ("5.5 ± 1 s", "range", 4.5, 6.5), ("== 1", "equal", 1, None), ("!= 0", "not_equal", 0, None), ("70 kPa", "bare", None, 70), ("≥ 3", "lower", 3, None), ("− 3", None, None, None)],
)
def test_limits(text, kind, low, up):
    if kind is None:
        return
    limit = CELLS.limit(text)
    assert limit.kind == kind
    assert (limit.lower.quantity.value if limit.lower else None, limit.upper.quantity.value if limit.upper else None) == (low, up)


FORMS = [
    ("< 70 kPa", "upper", None, (70, False)), ("=< 70", "upper", None, (70, True)), ("=> 3", "lower", (3, True), None), ("> -3.5e2 V", "lower", (-350, False), None),
    ("<> 4", "not_equal", (4, True), None), ("= 5 V", "equal", (5, True), None), ("== -1", "equal", (-1, True), None), ("≤70 kPa", "upper", None, (70, True)),
    ("shall not exceed 9 V", "upper", None, (9, True)), ("no more than 9", "upper", None, (9, True)), ("Greater than or equal to 2", "lower", (2, True), None), ("Maximum 4 mm", "upper", None, (4, True)),
    ("(1, 2] s", "range", (1, False), (2, True)), ("[1; 2) s", "range", (1, True), (2, False)), ("[-1,2]", "range", (-1, True), (2, True)),
    ("between 1 s and 2 s", "range", (1, True), (2, True)), ("1 to 2 s", "range", (1, True), (2, True)), ("1 s .. 2 s", "range", (1, True), (2, True)), ("1..2", "range", (1, True), (2, True)),
    ("1 … 2", "range", (1, True), (2, True)), ("-7 – -3 V", "range", (-7, True), (-3, True)), ("5 — 6", "range", (5, True), (6, True)), ("1.5V to 2 V", "range", (1.5, True), (2, True)),
    ("± 0.5 deg", "range", (-0.5, True), (0.5, True)), ("10 +/- 2 V", "range", (8, True), (12, True)), ("10 +- 2", "range", (8, True), (12, True)), ("10±2 V", "range", (8, True), (12, True)),
    ("−4 V", "bare", None, (-4, True)), (".5", "bare", None, (0.5, True)), (7, "bare", None, (7, True)), ("12\u00a0V", "bare", None, (12, True)),
]


@pytest.mark.parametrize("text,kind,low,up", FORMS)
def test_every_form_of_a_limit(text, kind, low, up):
    limit = CELLS.limit(text)
    end = lambda side: side and (side.quantity.value, side.inclusive)
    assert (limit.kind, end(limit.lower), end(limit.upper)) == (kind, low, up)


def test_limits_by_expression_units_and_commas():
    upper = lambda text, **more: CELLS.limit(text, **more).upper
    assert upper("curve(q_max, alt)").expr == "curve(q_max, alt)" and upper("<= table(q_max)").expr == "curve(q_max)"
    assert upper("= 2 * param.limit").expr == "2 * param.limit" and upper("max curve(a, b)").expr == "curve(a, b)"
    both = CELLS.limit("[curve(low), curve(high, x)]")
    assert (both.lower.expr, both.upper.expr) == ("curve(low)", "curve(high, x)")
    assert upper("<= 3", unit="kPa").quantity.unit == "kPa" and upper("<= 3 Pa", unit="kPa").quantity.unit == "Pa"
    assert CELLS.limit("1 .. 2 V").lower.quantity.unit == "V" and CELLS.limit("1 V to 2").upper.quantity.unit == "V"
    comma = Cells(decimal_comma=True)
    assert comma.limit("<= 1,5 V").upper.quantity.value == 1.5 and comma.limit("0,5 .. 1,5").lower.quantity.value == 0.5
    assert all(CELLS.limit(text) is None for text in (None, "", " - ", "None", "N/A", "—"))
    m = CELLS.columns("1", "2", "V")
    assert (m.kind, m.lower.quantity.value, m.upper.quantity.value) == ("range", 1, 2)
    assert CELLS.columns("1", "n/a").kind == "lower" and CELLS.columns(None, 2).kind == "upper" and CELLS.columns("", "-") is None
    for bad in ("<= 3 kumquats", "between 3 and 1 V", "5 ± -1 V", ">=", "3 V .. 2 V"):
        with pytest.raises(LimitError):
            CELLS.limit(bad)


def test_cells_that_cannot_be_read():
    with pytest.raises(LimitError):
        CELLS.limit("[7, -7] deg")
    with pytest.raises(LimitError):
        CELLS.limit("<=")
    assert CELLS.limit("n/a") is None and CELLS.tolerance("3 samples") == (0.0, 3) and CELLS.tolerance("100 ms") == (0.1, 0)
    assert CELLS.margin("5 %") == (None, 0.05) and CELLS.count("2") == 2


def test_units():
    u = Units({"furlong": "201.168 m"})
    assert u.convert(1, "km", "m") == 1000 and abs(u.convert(20, "degC", "K") - 293.15) < 1e-9 and u.convert(1, "furlong", "m") == 201.168
    with pytest.raises(UnitError):
        u.factor("kg", "m")


@pytest.mark.parametrize("text", ["open('x')", "value.__class__", "[x for x in y]", "lambda: 1", "vale + 1", "value + 1 kg", "max(3)", "value is 3", "movmean(value, value)", "a" * 3000])
def test_rejected_expressions(spark, text):
    with pytest.raises((ExprError, UnitError)):
        Compiler(Scope(signals={"value": Signal("value", "m")})).compile(text)


def frame(spark, values, **more):
    rows = [(1, i, float(i), x, *[m[i] for m in more.values()]) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "run_id int, idx long, t double, value double" + "".join(f", {k} boolean" for k in more))


def verdict(spark, values, rules=None, kind=None, check="value", **case):
    out = Checker(frame(spark, values), Scope(signals={"value": Signal("value")}), rules).one(Requirement("R", check, kind, cases=[Case(1, **case)]))
    return out.first()


def test_bound_verdicts(spark):
    r = verdict(spark, [1.0, 3.0, 5.0, 3.0, 1.0], limit="<= 4")
    assert (r.verdict, r.value, r.margin, r.at, r.runs, r.first_violation, r.violating_time) == ("fail", 5.0, -1.0, 2.0, 1, 1.5, 1.0)
    assert verdict(spark, [1.0, 3.0, 5.0, 3.0, 1.0], limit="<= 4", tolerance="1 s").verdict == "pass"
    assert verdict(spark, [1.0, 3.0, 5.0, 3.0, 1.0], limit="<= 4", tolerance="1 sample").verdict == "pass"
    assert verdict(spark, [1.0, 4.0, 1.0], limit="< 4").verdict == "fail"
    r = verdict(spark, [1.0, 4.0, 1.0], limit="<= 4")
    assert (r.verdict, r.margin) == ("pass", 0.0)
    assert verdict(spark, [1.0, 3.9, 1.0], limit="<= 4", margin="5 %").verdict == "warn"
    assert verdict(spark, [1.0, 0.0], limit="<= 0").margin_pct is None


def test_gaps_and_nothing_to_check(spark):
    assert verdict(spark, [1.0, None, 1.0], limit="<= 4").verdict == "warn"
    assert verdict(spark, [1.0, None, 1.0], Rules(on_gap="fail"), limit="<= 4").verdict == "fail"
    assert verdict(spark, [1.0, None, 1.0], Rules(on_gap="note"), limit="<= 4").verdict == "pass"
    assert verdict(spark, [1.0, 2.0], limit="<= 4", when="value > 9").verdict == "not_applicable"
    assert verdict(spark, [None, None], limit="<= 4").verdict == "not_applicable"


def test_errors_stay_with_their_requirement(spark):
    r = verdict(spark, [1.0], limit="<= 4 kg", check="vlue")
    assert r.verdict == "error" and "value" in r.reason


def test_three_valued_conditions(spark):
    c = Compiler(Scope(signals={"value": Signal("value")}))
    rows = frame(spark, [1.0, None, 3.0]).select(c.compile("value > 2 or value < 2").column.alias("a"), c.compile("value > 2 and False").column.alias("b")).collect()
    assert [tuple(r) for r in rows] == [(True, False), (None, False), (True, False)]


def test_table_of_cases():
    rows = [["Report"], ["Req ID", "Check", "Type", "Limit", "When", "Status"], ["A", "value", "upper", "4", "value > 1", "ok"], ["A", "value", "upper", "5", "", "ok"], ["B", "", "", "", "", "ok"], ["C", "value", "upper", "5", "", "draft"], ["", "Heading", "", "", "", ""]]
    s = table.load(rows, where={"Status": "ok"})
    assert [r.id for r in s.requirements] == ["A"] and len(s.requirements[0].cases) == 2 and s.not_covered == ["B"]
    assert s.requirements[0].kind == "upper" and s.requirements[0].cases[0].when == "value > 1"


def mixed(n):
    """n requirements of every kind, n >= 1 rounds."""
    out = []
    for i in range(n):
        out += [
            Requirement(f"U{i}", "value", cases=[Case(1, "low", when="value < 3", limit=f"<= {i + 1}"), Case(2, limit=f"<= {i + 4}", margin="50 %")]), Requirement(f"A{i}", f"value < {i + 3} or flag"),
            Requirement(f"M{i}", "value", "max", cases=[Case(1, limit=f"<= {i + 4}")]), Requirement(f"D{i}", f"value > {i + 2}", "duration", cases=[Case(1, limit="<= 1 s")]), Requirement(f"E{i}", "vlue", cases=[Case(1, limit="<= 1")]),
        ]
    return [r if r.cases else Requirement(r.id, r.check, r.kind, cases=[Case(1)]) for r in out]


def wide(spark):
    rows = [(run, i, float(i), None if (i + run) % 7 == 3 else float((i * (run + 1)) % 6), i % 3 == 0) for run in (1, 2, 3) for i in range(20)]
    return Checker(spark.createDataFrame(rows, "run_id int, idx long, t double, value double, flag boolean"), Scope(signals={"value": Signal("value"), "flag_": Signal("flag")}, conditions={"flag": "value == 2"}))


def test_many_requirements_are_what_each_is_alone(spark):
    c, reqs = wide(spark), mixed(2)
    got = {(r.run_id, r.id): tuple(r) for r in c.check(reqs).collect()}
    alone = {(r.run_id, r.id): tuple(r) for q in reqs for r in c.one(q).collect()}
    assert got == alone and len(got) == 3 * len(reqs)
    assert {v[3] for v in got.values()} >= {"fail", "error", "warn"}
    assert c.check([]).count() == 0


def test_exchanges_do_not_grow_with_requirements(spark):
    def exchanges(n):
        plan = wide(spark).check(mixed(n))._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan.count("Scan")

    assert exchanges(1) == exchanges(8)
    assert wide(spark).check(mixed(4)[:2])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
