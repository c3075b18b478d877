"""Registered queries of the expression language and the requirement checker, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens import samples as S
from runlens.functions.expr import Compiler, Scope, Signal
from runlens.functions.units import Units
from runlens.operators import events as E
from runlens.queries_signals import EG, EV, crossing_sql
from runlens.reqs import batch as B
from runlens.reqs.check import Checker, Rules
from runlens.reqs.table import Case, Requirement

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


CURVE = {"points": [(0.0, 80.0), (50.0, 120.0), (400.0, 300.0)], "x": "value", "mode": "linear", "outside": "hold"}


def frame(spark, sf, gaps: bool = True):
    """Wide frame of the event runs: value, event_type, triggers of `high` (over 60) and `buy`, and the parameter tier."""
    s = S.event_samples(spark, sf)
    types = S.event_samples(spark, sf, labels=True).where("signal = 'event_type'")
    wide = E.attach(S.event_wide(spark, sf, gaps), {"high": E.crossing_event(s, "high", 60.0, "rising"), "buy": E.equals_event(types, "buy", F.col("label") == "purchase")})
    tier = F.when(F.col("run_id") % 3 == 0, "gold").when(F.col("run_id") % 3 == 1, "silver").otherwise("bronze")
    return wide.withColumn("tier", tier).withColumn("quota", (F.col("run_id") % 5 + 1).cast("string"))


def scope() -> Scope:
    return Scope(
        signals={"value": Signal("value", "m"), "event_type": Signal("event_type", kind="text", discrete=True)}, conditions={"calm": "value < 50 m"}, aliases={"double": "2 * value"},
        events=("high", "buy"), params={"tier": "tier", "quota": "quota"}, curves={"ramp": CURVE}, units=Units({"furlong": "201.168 m"}),
    )


WIDE = f"""{EV}, hi AS (WITH {crossing_sql(EV, 60.0, edge="rising")} SELECT run_id, list(tc ORDER BY tc) AS h FROM flips WHERE reported GROUP BY run_id),
buy AS (SELECT run_id, list(t ORDER BY t) AS b FROM (SELECT run_id, t, event_type, lag(event_type) OVER (PARTITION BY run_id ORDER BY idx) AS was FROM ev) WHERE event_type = 'purchase' AND was IS DISTINCT FROM 'purchase' GROUP BY run_id),
wide AS (SELECT ev.run_id, idx, t, CASE WHEN event_type <> 'error' THEN x END AS value, event_type, coalesce(h, []) AS h, coalesce(b, []) AS b, CASE ev.run_id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS tier, ev.run_id % 5 + 1 AS quota FROM ev LEFT JOIN hi USING (run_id) LEFT JOIN buy USING (run_id))"""


def _expressions(name: str, texts: dict[str, str], sql: dict[str, str], places: int | None = None, window: str = ""):
    """One query of several expressions by sample."""
    wrap = (lambda s, k: f"round({s}, {places}) AS {k}") if places else (lambda s, k: f"{s} AS {k}")
    columns = ", ".join(wrap(sql[k], k) for k in texts)

    @query(name, f"WITH {WIDE} SELECT run_id, idx, {columns} FROM wide {window}")
    def _(spark, sf):
        c = Compiler(scope())
        nodes = {k: c.compile(t) for k, t in texts.items()}
        out = c.prepare(frame(spark, sf))
        values = {k: n.column if n.raw is None else n.raw for k, n in nodes.items()}
        return out.select("run_id", "idx", *[(F.round(v, places) if places else v).alias(k) for k, v in values.items()])


_expressions("expr_arith", {"a": "value + 1 km", "b": "value * 2 - 3 m", "c": "value / 5 m", "d": "-value + double", "e": "value / (value - value)", "f": "value ** 2"}, {"a": "value + 1000", "b": "value * 2 - 3", "c": "value / 5", "d": "-value + 2 * value", "e": "value / nullif(value - value, 0)", "f": "pow(value, 2)"}, 9)
_expressions(
    "expr_3vl",
    {"a": "value > 50 and event_type == 'click'", "b": "value > 50 or event_type == click", "c": "not value > 50", "d": "20 < value <= 80", "e": "calm or value > 100"},
    {"a": "value > 50 AND event_type = 'click'", "b": "value > 50 OR event_type = 'click'", "c": "NOT value > 50", "d": "value > 20 AND value <= 80", "e": "value < 50 OR value > 100"},
)
_expressions("expr_membership", {"a": "event_type in ('click', view)", "b": "event_type not in ('click',)", "c": "value in (1, 2, 3)"}, {"a": "event_type IN ('click', 'view')", "b": "event_type NOT IN ('click')", "c": "value IN (1, 2, 3)"})
_expressions("expr_where", {"a": "value if value > 50 else 0 m", "b": "where(event_type == 'view', 1, 2)"}, {"a": "CASE WHEN value > 50 THEN value WHEN NOT value > 50 THEN 0.0 END", "b": "CASE WHEN event_type = 'view' THEN 1.0 WHEN NOT event_type = 'view' THEN 2.0 END"})
_expressions("expr_minmax_clip", {"a": "min(value, 30, 40)", "b": "max(value, 0.05 km)", "c": "clip(value, 10, 90)", "d": "abs(value - 50)", "e": "sign(value - 50)"}, {"a": "least(value, 30, 40)", "b": "greatest(value, 50)", "c": "CASE WHEN value IS NOT NULL THEN least(greatest(value, 10), 90) END", "d": "abs(value - 50)", "e": "sign(value - 50)::DOUBLE"})
_expressions(
    "expr_trig",
    {"a": "sin(90 deg * (value / 100 m))", "b": "cos(value / 1 m)", "c": "sqrt(value / 1 m)", "d": "log(value / 1 m)", "e": "exp(-value / 100 m)", "f": "hypot(value, 3 m)"},
    {"a": "sin(90 * (value / 100) * (pi() / 180))", "b": "cos(value)", "c": "sqrt(value)", "d": "ln(value)", "e": "exp(-value / 100)", "f": "sqrt(value * value + 9)"},
    9,
)


@query("expr_units", f"WITH {WIDE} SELECT run_id, idx, round(value * 0.001, 9) AS a, value > 201.168 AS b, round(value + 0.3048, 9) AS c, round(quota * value, 9) AS d FROM wide")
def _(spark, sf):
    c = Compiler(scope())
    a, b, d, e = (c.compile(x).column for x in ("as_unit(value, 'km')", "value > 1 furlong", "value + 1 ft", "value * param.quota"))
    return frame(spark, sf).select("run_id", "idx", F.round(a, 9).alias("a"), b.alias("b"), F.round(d, 9).alias("c"), F.round(e, 9).alias("d"))


@query("expr_norm_embedding", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, embedding[1]::DOUBLE AS x, embedding[4]::DOUBLE AS k FROM embeddings")
def _(spark, sf):
    df = S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    c = Compiler(Scope(signals={"v": Signal("v", kind="vector")}))
    return df.select("vec_id", F.round(c.compile("norm(v)").column, 6).alias("norm"), c.compile("v.x").column.alias("x"), c.compile("v[3]").column.alias("k"))


@query("expr_curve", f"WITH {WIDE} SELECT run_id, idx, CASE WHEN value < 0 THEN 80.0 WHEN value < 50 THEN 80.0 + value * 0.8::DOUBLE WHEN value < 400 THEN 120.0 + (value - 50) * ({180 / 350!r})::DOUBLE WHEN value >= 400 THEN 300.0 END::DOUBLE AS y FROM wide")
def _(spark, sf):
    return frame(spark, sf).select("run_id", "idx", Compiler(scope()).compile("curve(ramp)").column.alias("y"))


_expressions(
    "expr_events",
    {"a": "after('high', 1 h)", "b": "before(buy)", "c": "during('high#all', 1 d)", "d": "between('high', 'buy')", "e": "count('high') > 5", "f": "since('high') < 2 d"},
    {"a": "coalesce(t >= h[1] + 3600, false)", "b": "coalesce(t < b[1], true)", "c": "len(list_filter(h, lambda a: t >= a AND t < a + 86400)) > 0", "d": "coalesce(t >= h[1] AND coalesce(t < list_min(list_filter(b, lambda e: e >= h[1])), true), false)", "e": "len(h) > 5", "f": "CASE WHEN t >= h[1] THEN t - h[1] < 172800 END"},
)
_expressions(
    "expr_aggregates",
    {"a": "max(value)", "b": "min(value)", "c": "initial(value)", "d": "final(value)", "e": "value - mean(value)", "f": "rms(value)", "g": "duration(value > 50) / 1 h", "h": "at('high', value)"},
    {
        "a": "max(value) OVER r", "b": "min(value) OVER r", "c": "first_value(value IGNORE NULLS) OVER (r ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "d": "last_value(value IGNORE NULLS) OVER (r ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        "e": "value - (sum((tn - t) * 0.5 * (value + vn)) OVER r) / (sum(CASE WHEN value IS NOT NULL AND vn IS NOT NULL THEN tn - t END) OVER r)", "f": "sqrt((sum((tn - t) * (value * value + vn * vn + value * vn) / 3.0) OVER r) / (sum(CASE WHEN value IS NOT NULL AND vn IS NOT NULL THEN tn - t END) OVER r))",
        "g": "coalesce(sum(CASE WHEN value > 50 AND vn > 50 THEN tn - t END) OVER r, 0) / 3600", "h": "CASE WHEN lt = h1 THEN lv ELSE lv + (h1 - lt) / (rt - lt) * (rv - lv) END",
    },
    6,
    "WINDOW r AS (PARTITION BY run_id)",
)
ORACLES["expr_aggregates"] = ORACLES["expr_aggregates"].replace(
    "FROM wide WINDOW",
    """FROM (SELECT *, (max((t, idx, value)) FILTER (t <= h1) OVER q)[3] AS lv, (max((t, idx, value)) FILTER (t <= h1) OVER q)[1] AS lt, (min((t, idx, value)) FILTER (t > h1) OVER q)[3] AS rv, (min((t, idx, value)) FILTER (t > h1) OVER q)[1] AS rt
FROM (SELECT *, h[1] AS h1, lead(t) OVER (PARTITION BY run_id ORDER BY idx) AS tn, lead(value) OVER (PARTITION BY run_id ORDER BY idx) AS vn FROM wide) WINDOW q AS (PARTITION BY run_id)) WINDOW""",
)
_expressions(
    "expr_deriv",
    {"a": "deriv(value) * 1 h", "b": "abs(deriv(value))"},
    {"a": "d * 1", "b": "abs(d)"},
    7,
)
ORACLES["expr_deriv"] = ORACLES["expr_deriv"].replace(
    "FROM wide",
    """FROM (SELECT *, CASE WHEN tp IS NULL THEN (vn - value) / (tn - t) WHEN tn IS NULL THEN (value - vp) / (t - tp) ELSE ((t - tp) * (t - tp) * vn + ((tn - t) * (tn - t) - (t - tp) * (t - tp)) * value - (tn - t) * (tn - t) * vp) / ((t - tp) * (tn - t) * ((t - tp) + (tn - t))) END AS d
FROM (SELECT *, lag(t) OVER w AS tp, lag(value) OVER w AS vp, lead(t) OVER w AS tn, lead(value) OVER w AS vn FROM wide WINDOW w AS (PARTITION BY run_id ORDER BY idx)))""",
)


# ---- requirements
def req(check: str, kind: str | None = None, unit: str | None = None, **case: str) -> Requirement:
    return Requirement("R1", check, kind, unit=unit, cases=[Case(1, **case)])


def bound_sql(x="value", claim="0", up="NULL", lo="NULL", su=False, sl=False, mu="NULL", ml="NULL", tol_s="0", tol_n="0", unknown="false", discrete=False, gap="warn", tolerated="pass", base=WIDE, labels=("1",)) -> str:
    """A bound check in SQL. up, lo, tolerances and margins may depend on `claim`; an assertion has x as a condition."""
    is_assert = x.startswith("assert ")
    ok = x.removeprefix("assert ")
    e = f"CASE WHEN claim IS NOT NULL THEN CASE WHEN {ok} THEN -1.0 WHEN NOT ({ok}) THEN 1.0 END END" if is_assert else "greatest(x - up, lo - x)"
    strict = lambda s, c: f"coalesce({c} = 0, false)" if s else "false"
    line = lambda ta, tb, xa, xb: f"least(greatest({ta} + ({tb} - {ta}) * (0.0 - {xa}) / nullif({xb} - {xa}, 0), {ta}), {tb})"

    def found(hit, e):
        start = "t" if discrete else f"CASE WHEN pe IS NULL THEN t ELSE {line('pt', 't', 'pe', e)} END"
        end = "coalesce(nt, t)" if discrete else f"CASE WHEN ne IS NULL THEN t ELSE {line('t', 'nt', e, 'ne')} END"
        return f"""(SELECT run_id, s, z, z - s AS d, (ts > 0 AND z - s <= ts) OR n <= tn AS tol FROM (SELECT run_id, k, first({start} ORDER BY idx) AS s, last({end} ORDER BY idx) AS z, count(*) AS n, min(ts) AS ts, min(tn) AS tn
FROM (SELECT *, idx - row_number() OVER (PARTITION BY run_id, {hit} ORDER BY idx) AS k, lag({e}) OVER w AS pe, lag(t) OVER w AS pt, lead({e}) OVER w AS ne, lead(t) OVER w AS nt FROM ex WINDOW w AS (PARTITION BY run_id ORDER BY idx)) WHERE {hit} GROUP BY run_id, k))"""

    xcol = "NULL::DOUBLE" if is_assert else x
    fin = f"({ok}) IS NOT NULL" if is_assert else "x IS NOT NULL"
    bad = f"(claim IS NOT NULL AND NOT fin){' OR (unknown AND claim IS NULL)' if is_assert else ''}"
    region = f"claim IS NOT NULL{' OR unknown' if is_assert else ''}"
    names = ", ".join(f"'{n}'" for n in labels)
    return f"""WITH {base}, k0 AS (SELECT *, {claim} AS claim, ({unknown}) AS unknown FROM wide), k1 AS (SELECT *, {xcol} AS x, CASE WHEN claim IS NOT NULL THEN {up} END::DOUBLE AS up, CASE WHEN claim IS NOT NULL THEN {lo} END::DOUBLE AS lo, ({tol_s})::DOUBLE AS ts, ({tol_n}) AS tn FROM k0),
ex AS (SELECT run_id, idx, t, claim, unknown, x, {fin} AS fin, ts, tn, {e} AS e, CASE WHEN lo IS NULL OR x - up >= lo - x THEN up ELSE lo END AS bound, coalesce({e} > 0, false){'' if is_assert else f' OR {strict(su, "x - up")} OR {strict(sl, "lo - x")}'} AS viol, greatest(x - up + ({mu}), lo - x + ({ml})) AS we, coalesce(greatest(x - up + ({mu}), lo - x + ({ml})) > 0, false) AS wviol FROM k1),
tt AS (SELECT *, lead(t) OVER w - t AS dt, {bad} AS bad, lead({bad}) OVER w AS nbad, ({region}) AS reg, lead({region}) OVER w AS nreg, lead(claim IS NOT NULL) OVER w AS nclaim FROM ex WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
r AS (SELECT run_id, count(*) FILTER (claim IS NOT NULL AND fin) AS usable, coalesce(sum(dt) FILTER (claim IS NOT NULL AND {'true' if discrete else 'nclaim'}), 0) AS active_time, coalesce(sum(dt) FILTER ((bad OR nbad) AND reg AND nreg), 0) AS gap_time,
 first(x ORDER BY e DESC, idx) FILTER (fin AND e IS NOT NULL) AS value, first(bound ORDER BY e DESC, idx) FILTER (fin AND e IS NOT NULL) AS limit_, first(t ORDER BY e DESC, idx) FILTER (fin AND e IS NOT NULL) AS at_, max(e) FILTER (fin) AS e, first(claim ORDER BY e DESC, idx) FILTER (fin AND e IS NOT NULL) AS c FROM tt GROUP BY run_id),
v AS (SELECT run_id, count(*) FILTER (NOT tol) AS runs, sum(d) FILTER (NOT tol) AS vt, count(*) FILTER (tol) AS tolerated, min(s) FILTER (NOT tol) AS fv FROM {found('viol', 'e')} GROUP BY run_id),
wv AS (SELECT run_id, count(*) FILTER (NOT tol) AS warned FROM {found('wviol', 'we')} GROUP BY run_id),
o AS (SELECT r.*, coalesce(runs, 0) AS runs, coalesce(vt, 0) AS vt, coalesce(tolerated, 0) AS tolerated, fv, coalesce(warned, 0) AS warned FROM r LEFT JOIN v USING (run_id) LEFT JOIN wv USING (run_id))
SELECT run_id, CASE WHEN usable = 0 THEN 'not_applicable' WHEN runs > 0 OR ({'gap_time > 0' if gap == 'fail' else 'false'}) THEN 'fail' WHEN warned > 0 OR ({'gap_time > 0' if gap == 'warn' else 'false'}) OR ({'tolerated > 0' if tolerated == 'warn' else 'false'}) THEN 'warn' ELSE 'pass' END AS verdict,
value, limit_ AS "limit", {'NULL::DOUBLE' if is_assert else 'CASE WHEN e = 0 THEN 0.0 ELSE -e END'} AS margin, CASE WHEN usable > 0 THEN {'fv' if is_assert else 'at_'} END AS "at", ([{names}])[c + 1] AS "case", runs, round(vt, 6) AS violating_time, tolerated, fv AS first_violation, round(active_time, 6) AS active_time, round(gap_time, 6) AS gap_time FROM o"""


def _req(name: str, requirement: Requirement, sql: str, rules: Rules | None = None, gaps: bool = True):
    @query(name, sql)
    def _(spark, sf):
        out = Checker(frame(spark, sf, gaps), scope(), rules).one(requirement)
        return out.select("run_id", "verdict", "value", "limit", "margin", "at", "case", "runs", F.round("violating_time", 6).alias("violating_time"), "tolerated", "first_violation", F.round("active_time", 6).alias("active_time"), F.round("gap_time", 6).alias("gap_time"))


CALM = "CASE WHEN event_type <> 'view' THEN 0 END"
_req("req_bound_upper", req("value", limit="<= 100 m", when="event_type != 'view'", tolerance="1 h", margin="5 %"), bound_sql(claim=CALM, up="100", mu="abs(up) * 0.05", tol_s="3600"))
_req("req_bound_lower", req("value", limit=">= 5 m"), bound_sql(lo="5"))
_req("req_bound_range", req("value", limit="[5, 100] m", margin="2 m"), bound_sql(up="100", lo="5", mu="2", ml="2"))
_req("req_bound_between_words", req("value", limit="between 5 and 120 m", tolerance="2 samples"), bound_sql(up="120", lo="5", tol_n="2"))
_req("req_bound_curve", req("value", limit="<= curve(ramp)"), bound_sql(up=f"CASE WHEN value < 0 THEN 80.0 WHEN value < 50 THEN 80.0 + value * 0.8::DOUBLE WHEN value < 400 THEN 120.0 + (value - 50) * ({180 / 350!r})::DOUBLE WHEN value >= 400 THEN 300.0 END"))
_req("req_bound_tolerance", req("value", limit="max 80 m", tolerance="2 d"), bound_sql(up="80", tol_s="172800", tolerated="warn"), Rules(on_tolerated="warn"))
_req("req_bound_margin", req("value", limit="<= 200 m", margin="20 %"), bound_sql(up="200", mu="abs(up) * 0.2"))
_req("req_bound_events", req("value", limit="<= 90 m", when="during('high#all', 2 d)"), bound_sql(claim="CASE WHEN len(list_filter(h, lambda a: t >= a AND t < a + 172800)) > 0 THEN 0 END", up="90"))
_cases = Requirement("R1", "value", cases=[Case(1, "calm", when="event_type == 'click'", limit="<= 60 m"), Case(2, "gold", applies_to="tier == 'gold'", limit="<= 150 m", tolerance="1 d"), Case(3, "rest", limit="<= 90 m")])
_req("req_bound_cases", _cases, bound_sql(claim="CASE WHEN event_type = 'click' THEN 0 WHEN tier = 'gold' THEN 1 ELSE 2 END", up="CASE claim WHEN 0 THEN 60 WHEN 1 THEN 150 ELSE 90 END", tol_s="CASE claim WHEN 1 THEN 86400 ELSE 0 END", labels=("calm", "gold", "rest")))
_req("req_bound_param_limit", req("value", limit="= 20 * param.quota", kind="upper"), bound_sql(up="20.0 * quota"))
_req("req_gap_policy", req("value", limit="<= 450 m"), bound_sql(up="450", gap="fail"), Rules(on_gap="fail"))
_req("req_gap_note", req("value", limit="<= 450 m"), bound_sql(up="450", gap="note"), Rules(on_gap="note"))
_req("req_assert", req("value < 150 or event_type == 'click'", when="after('buy')"), bound_sql(x="assert value < 150 OR event_type = 'click'", claim="CASE WHEN coalesce(t >= b[1], false) THEN 0 END"))
_req("req_assert_calm", req("calm or value < 90", kind="assert", tolerance="1 d"), bound_sql(x="assert value < 50 OR value < 90", tol_s="86400"))


@query(
    "req_bound_strict",
    """WITH q AS (SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, l_quantity AS x FROM lineitem)
SELECT run_id, CASE WHEN max(x) >= 50 THEN 'fail' ELSE 'pass' END AS verdict, max(x) AS value, 50 - max(x) AS margin FROM q GROUP BY run_id""",
)
def _(spark, sf):
    wide = S.lineitem_samples(spark, sf).withColumnRenamed("x", "quantity")
    out = Checker(wide, Scope(signals={"quantity": Signal("quantity")})).one(req("quantity", limit="< 50"))
    return out.select("run_id", "verdict", "value", "margin")


@query(
    "req_bound_discrete",
    """WITH d AS (SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, epoch_us(l_shipdate) / 1e6 AS t, l_linenumber AS x FROM lineitem),
n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY idx), t) AS nt, idx - row_number() OVER (PARTITION BY run_id, x > 4 ORDER BY idx) AS k FROM d), g AS (SELECT run_id, k, arg_max(nt, idx) - arg_min(t, idx) AS len FROM n WHERE x > 4 GROUP BY run_id, k)
SELECT d.run_id, CASE WHEN count(len) > 0 THEN 'fail' ELSE 'pass' END AS verdict, any_value(m)::DOUBLE AS value, count(len) AS runs, round(coalesce(sum(len), 0), 6) AS violating_time FROM (SELECT run_id, max(x) AS m FROM d GROUP BY run_id) d LEFT JOIN g USING (run_id) GROUP BY d.run_id""",
)
def _(spark, sf):
    wide = S.from_dataframe(S.table(spark, sf, "lineitem"), "l_suppkey", S.seconds(F.col("l_shipdate")), {"line": F.col("l_linenumber")}, ["l_orderkey", "l_linenumber"]).withColumnRenamed("x", "line")
    out = Checker(wide, Scope(signals={"line": Signal("line", discrete=True)})).one(req("line", limit="<= 4"))
    return out.select("run_id", "verdict", "value", "runs", F.round("violating_time", 6).alias("violating_time"))


DUR = f"""WITH {WIDE}, ex AS (SELECT run_id, idx, t, CASE WHEN event_type <> 'view' THEN value - 60 END AS e FROM wide), d AS (SELECT *, coalesce(e > 0, false) AS hit, lag(e) OVER w AS pe, lag(t) OVER w AS pt, lead(e) OVER w AS ne, lead(t) OVER w AS nt FROM ex WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY run_id, hit ORDER BY idx) AS k FROM d), s AS (SELECT run_id, k, first(CASE WHEN pe IS NULL THEN t ELSE least(greatest(pt + (t - pt) * (0.0 - pe) / nullif(e - pe, 0), pt), t) END ORDER BY idx) AS a, last(CASE WHEN ne IS NULL THEN t ELSE least(greatest(t + (nt - t) * (0.0 - e) / nullif(ne - e, 0), t), nt) END ORDER BY idx) AS z FROM g WHERE hit GROUP BY run_id, k),
v AS (SELECT run_id, coalesce(sum(z - a), 0) AS total, count(a) AS runs FROM (SELECT DISTINCT run_id FROM wide) LEFT JOIN s USING (run_id) GROUP BY run_id)
SELECT run_id, CASE WHEN total > 864000 THEN 'fail' ELSE 'pass' END AS verdict, round(total, 6) AS value, 864000.0::DOUBLE AS "limit", runs FROM v"""


@query("req_duration", DUR)
def _(spark, sf):
    out = Checker(frame(spark, sf), scope()).one(req("value > 60 m", kind="duration", when="event_type != 'view'", limit="<= 10 d"))
    return out.select("run_id", "verdict", F.round("value", 6).alias("value"), "limit", "runs")


@query("req_value", f"WITH {WIDE} SELECT run_id, CASE WHEN m IS NULL THEN 'not_applicable' WHEN m > 300 THEN 'fail' WHEN m + 30 > 300 THEN 'warn' ELSE 'pass' END AS verdict, m AS value, 300.0::DOUBLE AS \"limit\", 300 - m AS margin FROM (SELECT run_id, max(value) FILTER (event_type = 'click') AS m FROM wide GROUP BY run_id)")
def _(spark, sf):
    out = Checker(frame(spark, sf), scope()).one(req("value", kind="max", when="event_type == 'click'", limit="<= 300 m", margin="10 %"))
    return out.select("run_id", "verdict", "value", "limit", "margin")


@query(
    "req_value_mean",
    f"""WITH {WIDE}, n AS (SELECT run_id, t, value, lead(t) OVER w AS tn, lead(value) OVER w AS vn FROM wide WINDOW w AS (PARTITION BY run_id ORDER BY idx)), m AS (SELECT run_id, sum((tn - t) * 0.5 * (value + vn)) / sum(tn - t) FILTER (value IS NOT NULL AND vn IS NOT NULL) AS m FROM n GROUP BY run_id)
SELECT run_id, CASE WHEN m > 55 OR m < 45 THEN 'fail' ELSE 'pass' END AS verdict, round(m, 6) AS value FROM m""",
)
def _(spark, sf):
    out = Checker(frame(spark, sf), scope()).one(req("mean(value)", limit="50 ± 5 m"))
    return out.select("run_id", "verdict", F.round("value", 6).alias("value"))


@query("req_value_text", f"WITH {WIDE} SELECT DISTINCT run_id, CASE WHEN tier <> 'gold' THEN 'not_applicable' WHEN len(h) = 5 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN tier = 'gold' THEN len(h) END::DOUBLE AS value FROM wide")
def _(spark, sf):
    return Checker(frame(spark, sf), scope()).one(req("count('high')", limit="== 5", applies_to="tier == 'gold'")).select("run_id", "verdict", "value")


@query("req_event", f"WITH {WIDE} SELECT DISTINCT run_id, CASE WHEN len(b) <> 10 OR b[1] IS NULL OR b[1] > 1705000000 THEN 'fail' ELSE 'pass' END AS verdict, b[1] AS value, len(b)::BIGINT AS runs FROM wide")
def _(spark, sf):
    return Checker(frame(spark, sf), scope()).one(req("buy", kind="event", limit="<= 1705000000 s", count="10")).select("run_id", "verdict", "value", "runs")


@query("req_missing_event", f"WITH {WIDE} SELECT DISTINCT run_id, CASE WHEN len(list_filter(b, lambda e: e >= 1e12)) <> 1 THEN 'fail' ELSE 'pass' END AS verdict, 0::BIGINT AS runs FROM wide")
def _(spark, sf):
    none = frame(spark, sf).withColumn("e_buy", F.filter("e_buy", lambda e: e >= 1e12))
    return Checker(none, scope()).one(req("buy", kind="event")).select("run_id", "verdict", "runs")


@query(
    "req_applies_to_segment",
    """WITH o AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx, o_totalprice AS x, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT run_id, CASE WHEN any_value(segment) <> 'BUILDING' THEN 'not_applicable' WHEN max(x) > 400000 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN any_value(segment) = 'BUILDING' THEN max(x) END AS value FROM o GROUP BY run_id""",
)
def _(spark, sf):
    s = S.from_dataframe(S.table(spark, sf, "orders"), "o_custkey", S.seconds(F.col("o_orderdate")), {"price": F.col("o_totalprice")}, ["o_orderkey"]).withColumnRenamed("x", "price")
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("segment"))
    out = Checker(s.join(c, "run_id"), Scope(signals={"price": Signal("price")}, params={"segment": "segment"})).one(req("price", limit="<= 400000", applies_to="segment == 'BUILDING'"))
    return out.select("run_id", "verdict", F.when(F.col("verdict") != "not_applicable", F.col("value")).alias("value"))


@query("req_error_isolated", "SELECT DISTINCT user_id AS run_id, 'error' AS verdict FROM events UNION ALL SELECT user_id, CASE WHEN max(value) FILTER (event_type <> 'error') > 1e9 THEN 'fail' ELSE 'pass' END FROM events GROUP BY user_id")
def _(spark, sf):
    reqs = [Requirement("A", "vallue + 1", cases=[Case(1, limit="<= 3")]), Requirement("B", "max(value)", cases=[Case(2, limit="<= 1e9")])]
    return Checker(frame(spark, sf), scope()).check(reqs).select("run_id", "verdict")


# ---- many requirements over many runs
BATCH = [
    Requirement("B1", "max(value)", cases=[Case(1, limit="<= 300 m", margin="20 %")]), Requirement("B2", "min(value)", cases=[Case(2, limit=">= 1 m")]),
    Requirement("B3", "count('high')", cases=[Case(3, limit="<= 15", applies_to="tier != 'bronze'")]), Requirement("B4", "final(value)", cases=[Case(4, limit="[10, 80] m")]),
]
RES = f"""WITH {WIDE}, a AS (SELECT run_id, max(value) AS b1, min(value) AS b2, any_value(len(h))::DOUBLE AS b3, any_value(tier) AS tier, last(value ORDER BY idx) FILTER (value IS NOT NULL) AS b4 FROM wide GROUP BY run_id),
res AS (SELECT run_id, 'B1' AS id, CASE WHEN b1 > 300 THEN 'fail' WHEN b1 + 60 > 300 THEN 'warn' ELSE 'pass' END AS verdict, b1 AS value, 300 - b1 AS margin, 300.0 AS lim FROM a
UNION ALL SELECT run_id, 'B2', CASE WHEN b2 < 1 THEN 'fail' ELSE 'pass' END, b2, b2 - 1, 1.0 FROM a
UNION ALL SELECT run_id, 'B3', CASE WHEN tier = 'bronze' THEN 'not_applicable' WHEN b3 > 15 THEN 'fail' ELSE 'pass' END, CASE WHEN tier <> 'bronze' THEN b3 END, 15 - b3, 15.0 FROM a
UNION ALL SELECT run_id, 'B4', CASE WHEN b4 > 80 OR b4 < 10 THEN 'fail' ELSE 'pass' END, b4, least(80 - b4, b4 - 10), NULL FROM a)"""
_CODE = "CASE verdict WHEN 'fail' THEN 0 WHEN 'error' THEN 1 WHEN 'warn' THEN 2 WHEN 'pass' THEN 3 ELSE 4 END"


def _batch(spark, sf):
    return Checker(frame(spark, sf), scope()).check(BATCH)


@query("batch_results", f"{RES} SELECT run_id, id, verdict, value, round(margin, 9) AS margin FROM res")
def _(spark, sf):
    return _batch(spark, sf).select("run_id", "id", "verdict", "value", F.round("margin", 9).alias("margin"))


@query("batch_matrix", f"{RES} SELECT run_id, " + ", ".join(f"max({_CODE}) FILTER (id = 'B{i}') AS \"B{i}\"" for i in range(1, 5)) + " FROM res GROUP BY run_id")
def _(spark, sf):
    return B.verdict_matrix(_batch(spark, sf), [r.id for r in BATCH])


@query("batch_margins", f"{RES} SELECT run_id, " + ", ".join(f"round(max(margin) FILTER (id = 'B{i}'), 9) AS \"B{i}\"" for i in range(1, 5)) + " FROM res GROUP BY run_id")
def _(spark, sf):
    m = B.margin_matrix(_batch(spark, sf), [r.id for r in BATCH])
    return m.select("run_id", *[F.round(r.id, 9).alias(r.id) for r in BATCH])


@query("batch_status", f"{RES} SELECT run_id, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("fail", "error", "warn", "pass", "not_applicable")) + f", (['fail', 'error', 'warn', 'pass', 'not_applicable'])[min({_CODE}) + 1] AS status FROM res GROUP BY run_id")
def _(spark, sf):
    return B.run_status(_batch(spark, sf))


@query(
    "batch_stats",
    f"""{RES}, s AS (SELECT id, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'warn') AS warn, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'not_applicable') AS not_applicable,
first(run_id ORDER BY verdict <> 'fail', round(margin, 9), run_id) FILTER (margin IS NOT NULL) AS worst_run, round(first(margin ORDER BY verdict <> 'fail', round(margin, 9), run_id) FILTER (margin IS NOT NULL), 9) AS worst_margin FROM res GROUP BY id)
SELECT *, fail + warn + pass AS checked, round(pass / (fail + warn + pass), 9) AS pass_rate FROM s""",
)
def _(spark, sf):
    r = _batch(spark, sf).withColumn("margin", F.round("margin", 9))
    return B.requirement_stats(r).select("id", "fail", "warn", "pass", "not_applicable", "worst_run", "worst_margin", "checked", F.round("pass_rate", 9).alias("pass_rate"))


@query(
    "batch_sentences",
    f"""{RES}, s AS (SELECT id, count(*) AS n, count(*) FILTER (verdict = 'fail') AS f, count(*) FILTER (verdict = 'warn') AS w, count(*) FILTER (verdict = 'pass') AS p FROM res GROUP BY id)
SELECT id, CASE WHEN f > 0 THEN printf('FAIL in %d/%d runs', f, n) WHEN w > 0 THEN printf('WARN in %d/%d runs', w, n) WHEN p = n THEN printf('PASS in all %d runs', n) WHEN p > 0 THEN printf('PASS in %d/%d runs', p, n) ELSE printf('N/A in all %d runs', n) END AS sentence FROM s""",
)
def _(spark, sf):
    return B.sentences(B.requirement_stats(_batch(spark, sf)))


@query("batch_worst", f"{RES}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_CODE}, round(margin, 9) NULLS LAST, run_id) AS place FROM res) SELECT run_id, id, verdict, place FROM p WHERE place <= 3")
def _(spark, sf):
    return B.overlay(_batch(spark, sf).withColumn("margin", F.round("margin", 9)), 3).select("run_id", "id", "verdict", "place")


@query("filter_runs", f"{RES} SELECT run_id, id, verdict FROM res WHERE value > 50 AND verdict = 'fail' AND id LIKE '%B%'")
def _(spark, sf):
    return B.filter_runs(_batch(spark, sf).select("run_id", "id", "verdict", "value"), "value>50 verdict=fail b").drop("value")


@query("violation_rows", f"WITH {EG}, d AS (SELECT *, coalesce(x > 100, false) AS hit FROM ev), g AS (SELECT *, idx - row_number() OVER (PARTITION BY run_id, hit ORDER BY idx) AS k FROM d), r AS (SELECT run_id, min(idx) AS i, count(*) AS samples, max(x) AS worst_value FROM g WHERE hit GROUP BY run_id, k), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) AS place FROM r) SELECT run_id, place, samples, worst_value FROM p WHERE place <= 4")
def _(spark, sf):
    c = Checker(frame(spark, sf), scope())
    return B.capped(c.violations(c.excess(c.bind(req("value", limit="<= 100 m")))), 4).select("run_id", "place", "samples", "worst_value")
