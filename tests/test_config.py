"""Mapping documents, events of mappings, and the context of a verdict."""

import pytest

from runlens.reqs import config
from runlens.reqs.check import Checker
from runlens.reqs.table import Case, Requirement
from runlens.sinks import to_xlsx
from runlens.sources.tables import SourceError

DOC = {
    "signals": {"q": {"path": "value", "unit": "kPa"}, "twice": {"expr": "2 * q"}}, "conditions": {"boost": "mode == 'UP'"},
    "events": {"high": {"when": "q > 4 kPa"}, "up": {"signal": "mode", "equals": "UP"}, "low": {"signal": "q", "falls_below": "3000 Pa"}}, "defaults": {"tolerance": "0 s", "on_gap": "fail"},
}


@pytest.fixture()
def frame(spark):
    rows = [(1, i, float(i), v, m) for i, (v, m) in enumerate(zip([1.0, 5.0, 6.0, 2.0, 5.0], ["UP", "UP", "DOWN", "DOWN", "UP"]))]
    return spark.createDataFrame(rows, "run_id int, idx long, t double, value double, mode string")


def test_layers_and_overrides():
    doc = config.layer({"defaults": {"tolerance": "1 s", "margin": "5 %"}}, {"defaults": {"tolerance": "2 s"}}, overrides=("defaults.on_gap=note",))
    assert doc["defaults"] == {"tolerance": "2 s", "margin": "5 %", "on_gap": "note"}
    with pytest.raises(SourceError, match="did you mean 'signals'"):
        config.layer({"signal": {}})


def test_config_sheets(tmp_path):
    (tmp_path / "c.xlsx").write_bytes(to_xlsx({"Signals": (["Name", "Path", "Unit"], [["q", "value", "kPa"]]), "Defaults": (["Name", "Value"], [["tolerance", "1 s"]]), "Notes": (["a"], [["b"]])}))
    assert config.from_workbook(str(tmp_path / "c.xlsx")) == {"signals": {"q": {"path": "value", "unit": "kPa"}}, "defaults": {"tolerance": "1 s"}}


def test_events_and_context(frame):
    scope = config.scope_of(DOC, frame)
    wide = config.attach_events(frame, DOC, scope)
    r = wide.first()
    assert r.e_high == pytest.approx([0.75, 3 + 2 / 3]) and r.e_up == [0.0, 4.0] and r.e_low == pytest.approx([2.75])
    out = Checker(wide, scope, config.rules_of(DOC)).one(Requirement("A", "twice", cases=[Case(1, limit="<= 11 kPa")]))
    v = out.first()
    assert (v.verdict, v.value, v.at) == ("fail", 12.0, 2.0)
    c = config.context(out, wide, scope).first()
    assert c.conditions == [] and c.last_event == "high" and c.since == 1.25


def test_unknown_column(frame):
    with pytest.raises(SourceError, match="did you mean 'value'"):
        config.scope_of({"signals": {"q": {"path": "valu"}}}, frame)
