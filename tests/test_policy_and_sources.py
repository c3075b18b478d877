"""Policies, compiled runs, files read and written."""

import csv
import zipfile

import pytest

from runlens import api, sinks
from runlens.functions.expr import Scope, Signal
from runlens.plans import compile, policy
from runlens.reqs import batch
from runlens.sources import signals, tables


def test_policy_issues_are_told_together():
    with pytest.raises(policy.PolicyError) as e:
        policy.load("version: 1\nhard:\n  valu: {global_extrema: {}}\n  value: {violation: {above: 1, below: 2}, window_extrema: {}, local_extrema: {prominence: -1, knd: max}}\nsync: [{members: [value]}]\n", ["value"])
    told = " | ".join(f"{i.path}: {i.message}" for i in e.value.issues)
    for part in ("did you mean 'value'", "one of above and below", "interval is missing", "can't be negative", "did you mean 'kind'", "two different members"):
        assert part in told
    assert any(i.line for i in e.value.issues)


def test_policy_keys_twice_and_canonical():
    with pytest.raises(policy.PolicyError):
        policy.load("version: 1\nversion: 1\n", [])
    a = policy.load("hard: {v: {violation: {above: 1}}}", ["v"])
    b = policy.load('{"hard": {"v": {"violation": {"min_duration": 0.0, "above": 1}}}}', ["v"])
    assert a.sha256 == b.sha256 and policy.size("64 KiB") == 65536


def test_policy_units():
    p = policy.load("hard: {v: {violation: {above: 1 km, min_duration: 2 min}}}", ["v"], {"v": "m"})
    assert p.hard[0].params["above"] == 1000 and p.hard[0].params["min_duration"] == 120


def test_budget_keeps_hard_samples_first(spark):
    s = signals.from_arrays(spark, {"t": list(range(100)), "v": [float(i % 7) for i in range(100)]})
    compiled, p = api.compile_runs(s, {"hard": {"v": {"global_extrema": {}}}}, max_size=24 * 10)
    row = compiled.budget.first()
    assert row.fits and row.hard_bytes <= row.bytes <= 240
    assert all(r.ok for r in api.verify_runs(s, compiled, p).collect())
    tight, _ = api.compile_runs(s, {"hard": {"v": {"global_extrema": {}}}}, max_size=24)
    assert not tight.budget.first().fits


@pytest.mark.parametrize("size", [200, 400, 600, 1000, 3000])
def test_sync_stays_within_the_budget(spark, size):
    """Two signals on shifted clocks: what a group adds is charged to the preview, and hard samples come with their partners."""
    rows = [(1, s, i, i + shift, float((i * 7) % 31), None, None) for s, shift in (("a", 0.0), ("b", 0.25)) for i in range(100)]
    samples = spark.createDataFrame(rows, "run_id int, signal string, idx long, t double, x double, raw string, label string")
    p = policy.load(f"version: 1\nhard: {{a: {{global_extrema: {{}}}}}}\nsync: [{{members: [a, b]}}]\nbudget: {{max_size: {size} B}}", ["a", "b"], {"a": "m", "b": "m"})
    out = compile.compile_runs(samples, p)
    b = out.budget.first()
    assert b.fits == (b.hard_bytes <= size) and (b.bytes <= size if b.fits else b.bytes == b.hard_bytes)
    kept = {(r.signal, r.idx) for r in out.retained.collect()}
    assert b.bytes == 24 * len(kept)
    quiet = {(r.signal, r.idx) for r in out.retained.where("role in ('extent', 'gap', 'sync')").collect()}
    loud = {(r.signal, r.idx) for r in out.retained.where("role not in ('extent', 'gap', 'sync')").collect()}
    partners = {("b", j) for s, i in loud if s == "a" for j in (i - 1, i) if i > 0} | {("a", j) for s, i in loud if s == "b" for j in (i, i + 1) if i < 99}
    assert kept == loud | partners | quiet and partners <= kept


def test_verification_finds_a_lost_sample(spark):
    from pyspark.sql import functions as F

    s = signals.from_arrays(spark, {"t": list(range(50)), "v": [float((i * 13) % 11) for i in range(50)]})
    compiled, p = api.compile_runs(s, "hard: {v: {threshold_crossing: {value: 5}}}\nsoft: [{match: '*', importance: none}]")
    lost = compiled.retained.where("role like '%threshold%'").agg(F.min("idx")).first()[0]
    compiled.retained = compiled.retained.where(F.col("idx") != lost)
    assert any(not r.ok for r in api.verify_runs(s, compiled, p).collect())


def test_csv_runs(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"run{k}.csv").write_text("# a comment\nTime [ms];v [m];mode;other\n0;1,5;a;1\n500;;b;2\n1000;inf;b;3\nx;1;1;1\n")
    df = signals.open_source(spark, str(tmp_path / "*.csv"), decimal_comma=True, names=["v", "mode"])
    rows = [(r.run_id, r.signal, r.idx, r.t, r.x, r.label) for r in df.orderBy("run_id", "signal", "idx").collect()]
    assert rows[:6] == [("run0", "mode", 0, 0.0, None, "a"), ("run0", "mode", 1, 0.5, None, "b"), ("run0", "mode", 2, 1.0, None, "b"), ("run0", "v", 0, 0.0, 1.5, None), ("run0", "v", 1, 0.5, None, None), ("run0", "v", 2, 1.0, None, None)]
    assert {r.run_id for r in signals.discover(spark, str(tmp_path)).collect()} == {"run0", "run1"}
    with pytest.raises(tables.SourceError):
        signals.select_names(["value", "other"], ["valu"])
    with pytest.raises(tables.SourceError):
        signals.open_source(spark, "x.h5")


def test_decreasing_times(spark, tmp_path):
    (tmp_path / "r.csv").write_text("t,v\n1,1\n0,2\n")
    with pytest.raises(Exception, match="times decrease"):
        signals.read_csv(spark, str(tmp_path / "r.csv")).collect()
    assert [r.x for r in signals.read_csv(spark, str(tmp_path / "r.csv"), on_non_monotonic="sort").orderBy("idx").collect()] == [2.0, 1.0]


def test_workbook_round_trip(tmp_path):
    rows = [["ID", "Check", "Limit"], ["A", "value", 3.5], ["B", "x < y & z", None], ["C", True, -2]]
    data = sinks.to_xlsx({"Reqs": (rows[0], rows[1:])})
    assert data == sinks.to_xlsx({"Reqs": (rows[0], rows[1:])})
    path = tmp_path / "b.xlsx"
    sinks.write_atomic(str(path), data)
    assert tables.read_xlsx(path) == rows and tables.sheets(path) == ["Reqs"]


def test_reqif(tmp_path):
    text = """<REQ-IF xmlns="http://www.omg.org/spec/ReqIF/20110401/reqif.xsd"><CORE-CONTENT><SPEC-TYPES><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="d1" LONG-NAME="Check"/><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="d2" LONG-NAME="ReqIF.ForeignID"/></SPEC-TYPES>
<SPEC-OBJECTS><SPEC-OBJECT IDENTIFIER="o1"><VALUES><ATTRIBUTE-VALUE-STRING THE-VALUE="max(v)"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>d1</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>
<ATTRIBUTE-VALUE-STRING THE-VALUE="R-1"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>d2</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING></VALUES></SPEC-OBJECT></SPEC-OBJECTS></CORE-CONTENT></REQ-IF>"""
    (tmp_path / "a.reqif").write_text(text)
    with zipfile.ZipFile(tmp_path / "a.reqifz", "w") as z:
        z.writestr("a.reqif", text)
    assert tables.read_table(tmp_path / "a.reqif") == tables.read_table(tmp_path / "a.reqifz") == [["ID", "Check"], ["R-1", "max(v)"]]


def test_check_end_to_end(spark, tmp_path):
    with open(tmp_path / "reqs.csv", "w") as f:
        csv.writer(f).writerows([["ID", "Check", "Type", "Limit", "Tolerance"], ["A", "v", "upper", "4 m", "1 s"], ["B", "max(v)", "", "<= 9 m", ""], ["C", "vv", "", "<= 9", ""], ["D", "", "", "", ""]])
    frame = spark.createDataFrame([(r, i, float(i), float(v)) for r, vs in ((1, [1, 5, 6, 5, 1]), (2, [1, 2, 3, 2, 1])) for i, v in enumerate(vs)], "run_id int, idx long, t double, v double")
    scope = Scope(signals={"v": Signal("v", "m")})
    reqs = api.load(str(tmp_path / "reqs.csv"))
    assert any("did you mean 'v'" in x or "unknown name" in x for x in api.lint(reqs, frame, scope))
    out = api.check(frame, reqs, scope)
    got = {(r.run_id, r.id): r.verdict for r in out.results.collect()}
    assert got == {(1, "A"): "fail", (2, "A"): "pass", (1, "B"): "pass", (2, "B"): "pass", (1, "C"): "error", (2, "C"): "error"}
    assert out.exit_code() == api.EXIT_FAIL and out.not_covered == ["D"]
    told = {r.id: r.sentence for r in batch.sentences(out.stats).collect()}
    assert told["A"] == "FAIL in 1/2 runs" and told["B"] == "PASS in all 2 runs"
    book = sinks.results_workbook(out.results, out.stats)
    (tmp_path / "r.xlsx").write_bytes(book)
    assert tables.sheets(tmp_path / "r.xlsx") == ["Requirements", "Results"]
    assert api.derive_policy(type(reqs)(reqs.requirements[:1], [], []), scope)["hard"] == {"v": {"global_extrema": {}}}


def test_formula_safe():
    assert sinks.safe("=1+1") == "'=1+1" and sinks.safe("a") == "a" and sinks.safe(-3) == -3


def test_parameters_and_resume(spark):
    runs = spark.createDataFrame([("r1", "a.csv", 5), ("r2", "b.csv", 6)], "run_id string, file string, length int")
    table = spark.createDataFrame([("r1", 1), ("b.csv", 2)], "run string, load int")
    got = {r.run_id: r.load for r in signals.run_parameters(table, runs, "run", ["run_id", "file"]).collect()}
    assert got == {"r1": 1, "r2": 2}
    assert [r.run_id for r in signals.pending_runs(runs, runs.where("run_id = 'r1'"), ["run_id", "length"]).collect()] == ["r2"]
