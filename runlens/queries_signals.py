"""Registered queries of the sample operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from runlens import samples as S
from runlens.functions import aggregates as A
from runlens.operators import detect as D
from runlens.operators import events as E
from runlens.operators import resample as R
from runlens.plans import preview as P

QUERIES, ORACLES = {}, {}

#: The event runs in SQL: plain, and with gaps where an event is an error.
EV = "ev AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) / 1e6 AS t, value AS x, event_type FROM events)"
EG = EV.replace("value AS x", "CASE WHEN event_type <> 'error' THEN value END AS x")
LI = "ev AS (SELECT l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, epoch_us(l_shipdate) / 1e6 AS t, l_quantity AS x FROM lineitem)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


EXTREMA_SQL = """SELECT run_id, first(idx ORDER BY x DESC, idx) FILTER (x IS NOT NULL) AS max_idx, max(x) AS max_value,
first(idx ORDER BY x, idx) FILTER (x IS NOT NULL) AS min_idx, min(x) AS min_value FROM ev GROUP BY run_id HAVING max(x) IS NOT NULL"""


@query("global_extrema_events", f"WITH {EV} {EXTREMA_SQL}")
def _(spark, sf):
    return D.global_extrema(S.event_samples(spark, sf)).select("run_id", "max_idx", "max_value", "min_idx", "min_value")


@query("global_extrema_gaps", f"WITH {EG} {EXTREMA_SQL}")
def _(spark, sf):
    return D.global_extrema(S.event_samples(spark, sf, gaps=True)).select("run_id", "max_idx", "max_value", "min_idx", "min_value")


@query("global_extrema_lineitem", f"WITH {LI} {EXTREMA_SQL}")
def _(spark, sf):
    return D.global_extrema(S.lineitem_samples(spark, sf)).select("run_id", "max_idx", "max_value", "min_idx", "min_value")


@query(
    "global_extrema_vector",
    """WITH c AS (SELECT label AS run_id, vec_id AS idx, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings)
SELECT run_id, component::INT AS component, first(idx ORDER BY x DESC, idx) AS max_idx, max(x) AS max_value, first(idx ORDER BY x, idx) AS min_idx, min(x) AS min_value FROM c GROUP BY ALL""",
)
def _(spark, sf):
    e = S.table(spark, sf, "embeddings").select(F.col("label").alias("run_id"), F.lit("embedding").alias("signal"), F.col("vec_id").alias("idx"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("v"))
    return D.global_extrema(S.components(e)).select("run_id", "component", "max_idx", "max_value", "min_idx", "min_value")


def _window_sql(base: str, interval: float, origin: float) -> str:
    ulp = "CASE WHEN m > 0 THEN pow(2.0, floor(log2(m)) - 52) ELSE 5e-324 END"
    return f"""WITH {base}, s AS (SELECT run_id, greatest(max(abs(t)), 0.0) / {interval:.1f} AS m FROM ev GROUP BY run_id),
b AS (SELECT ev.*, (t - {origin:.1f}) / {interval:.1f} AS u, 8.0 * ({ulp}) AS delta FROM ev JOIN s USING (run_id)),
k AS (SELECT *, floor(u + delta)::BIGINT AS m, abs(u - round_even(u, 0)) <= delta AS edge FROM b WHERE delta < 0.5 AND abs(u) < 4503599627370496),
p AS (SELECT run_id, idx, x, unnest(CASE WHEN edge THEN [m, m - 1] ELSE [m] END) AS bucket FROM k WHERE x IS NOT NULL)
SELECT run_id, bucket, first(idx ORDER BY x DESC, idx) AS max_idx, max(x) AS max_value, first(idx ORDER BY x, idx) AS min_idx, min(x) AS min_value
FROM p WHERE EXISTS (SELECT 1 FROM k WHERE k.run_id = p.run_id AND k.m = p.bucket) GROUP BY ALL"""


for _name, _base, _make, _interval, _origin in (
    ("window_extrema_events", EV, S.event_samples, 86400.0, 0.0),
    ("window_extrema_origin", EG, lambda spark, sf: S.event_samples(spark, sf, gaps=True), 604800.0, 3600.0),
    ("window_extrema_lineitem_week", LI, S.lineitem_samples, 604800.0, 0.0),
):

    @query(_name, _window_sql(_base, _interval, _origin))
    def _(spark, sf, make=_make, interval=_interval, origin=_origin):
        return D.window_extrema(make(spark, sf), interval, origin).drop("signal")


def crossing_sql(base: str, v: float, edge: str = "both", h: float = 0.0, d: float = 0.0, none: bool = False) -> str:
    tc = "t" if none else f"least(greatest(ta + (t - ta) * ({v} - xa) / nullif(x - xa, 0), ta), t)"
    keep = {"both": "true", "rising": "state", "falling": "NOT state"}[edge]
    return f"""{base}, f AS (SELECT run_id, idx, t, x, lag(x) OVER w AS xa, lag(t) OVER w AS ta, lag(idx) OVER w AS ia FROM ev WHERE x IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
z AS (SELECT run_id, max(idx) AS li, arg_max(t, idx) AS t_end FROM ev GROUP BY run_id),
m AS (SELECT *, CASE WHEN xa < {v} AND x >= {v} THEN idx END AS up, CASE WHEN xa >= {v} AND x < {v} THEN idx END AS dn, {tc} AS tc,
 CASE WHEN xa IS NULL THEN x >= {v} WHEN x >= {v + h / 2} THEN true WHEN x <= {v - h / 2} AND x < {v} THEN false END AS mark FROM f),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS state, first_value(x >= {v}) OVER w AS initial, last_value(up IGNORE NULLS) OVER w AS ui, last_value(dn IGNORE NULLS) OVER w AS di FROM m WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY idx) AS was FROM s),
c AS (SELECT q.run_id, q.idx AS confirm, q.state, q.initial, m.tc, m.ia AS before, m.idx AS after, m.t - m.ta AS disc FROM q JOIN m ON m.run_id = q.run_id AND m.idx = CASE WHEN q.state THEN q.ui ELSE q.di END WHERE q.state <> q.was),
u AS (SELECT c.*, lead(tc) OVER (PARTITION BY c.run_id ORDER BY confirm) AS nt, coalesce(lead(tc) OVER (PARTITION BY c.run_id ORDER BY confirm), t_end) - tc AS duration FROM c JOIN z USING (run_id)),
a AS (SELECT *, duration >= {d} AS accepted FROM u),
r AS (SELECT *, accepted AND state <> coalesce(last_value(CASE WHEN accepted THEN state END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY confirm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial) AS transition FROM a),
flips AS (SELECT *, transition AND {keep} AS reported, nt IS NULL AND NOT accepted AS pending FROM r)"""


_CROSS = "SELECT run_id, tc AS crossing, CASE WHEN state THEN 'rising' ELSE 'falling' END AS edge, before AS index_before, after AS index_after, confirm, after - before > 1 AS gap FROM flips WHERE reported"
for _name, _gaps, _o in (
    ("threshold_crossing_events", False, {}),
    ("threshold_crossing_hysteresis", True, {"h": 60.0}),
    ("threshold_crossing_debounce", True, {"h": 20.0, "d": 86400.0}),
    ("threshold_crossing_edge", False, {"edge": "rising"}),
    ("threshold_crossing_none", False, {"none": True}),
):

    @query(_name, f"WITH {crossing_sql(EG if _gaps else EV, 50.0, **_o)} {_CROSS}")
    def _(spark, sf, gaps=_gaps, o=_o):
        c = D.threshold_crossing(S.event_samples(spark, sf, gaps=gaps), 50.0, edge=o.get("edge", "both"), hysteresis=o.get("h", 0.0), debounce=o.get("d", 0.0), interpolate="none" if o.get("none") else "linear")
        return c.select("run_id", "crossing", "edge", "index_before", "index_after", "confirm", "gap")


@query(
    "threshold_crossing_summary",
    f"""WITH {crossing_sql(EG, 50.0, h=20.0, d=86400.0)} SELECT run_id, count(*) FILTER (reported) AS count, count(*) FILTER (reported AND state) AS rising, count(*) FILTER (reported AND NOT state) AS falling,
bool_or(pending) AS pending_at_end, count(*) FILTER (transition AND after - before > 1) AS gap_flips, count(*) AS flips FROM flips GROUP BY run_id""",
)
def _(spark, sf):
    return D.crossing_summary(S.event_samples(spark, sf, gaps=True), 50.0, hysteresis=20.0, debounce=86400.0).drop("signal")


@query(
    "threshold_crossing_retained",
    f"WITH {crossing_sql(EG, 50.0, h=20.0, d=86400.0)} SELECT DISTINCT run_id, unnest([before, after, confirm]) AS idx FROM flips",
)
def _(spark, sf):
    c = D.crossings(S.event_samples(spark, sf, gaps=True), 50.0, hysteresis=20.0, debounce=86400.0)
    return c.select("run_id", F.explode(F.array("index_before", "index_after", "confirm")).alias("idx")).distinct()


def violation_sql(base: str, limit: float, above: bool = True, least: float = 0.0) -> str:
    hit, order = ("x > ", "x DESC, idx") if above else ("x < ", "x, idx")
    line = lambda ta, tb, xa, xb: f"least(greatest({ta} + ({tb} - {ta}) * ({limit} - {xa}) / nullif({xb} - {xa}, 0), {ta}), {tb})"
    return f"""{base}, d AS (SELECT run_id, idx, t, x, coalesce({hit}{limit}, false) AS hit, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(idx) OVER w AS pi, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(idx) OVER w AS ni FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY run_id, hit ORDER BY idx) AS k FROM d),
o AS (SELECT run_id, k, min(idx) AS first_idx, max(idx) AS last_idx, first(idx ORDER BY {order}) AS worst_idx, first(t ORDER BY {order}) AS worst_t, first(x ORDER BY {order}) AS worst_value,
 first(CASE WHEN px IS NULL THEN t ELSE {line("pt", "t", "px", "x")} END ORDER BY idx) AS "start", last(CASE WHEN nx IS NULL THEN t ELSE {line("t", "nt", "x", "nx")} END ORDER BY idx) AS "end",
 bool_or(pi IS NULL) AS open_start, bool_or(ni IS NULL) AS open_end, first(pi IS NOT NULL AND px IS NULL ORDER BY idx) AS gap_start, last(ni IS NOT NULL AND nx IS NULL ORDER BY idx) AS gap_end FROM g WHERE hit GROUP BY run_id, k),
viol AS (SELECT * EXCLUDE (k) FROM o WHERE "end" - "start" >= {least})"""


for _name, _gaps, _o in (
    ("violation_above", False, {"limit": 100.0}),
    ("violation_below", False, {"limit": 10.0, "above": False}),
    ("violation_min_duration", False, {"limit": 100.0, "least": 43200.0}),
    ("violation_gaps", True, {"limit": 60.0}),
):

    @query(_name, f"WITH {violation_sql(EG if _gaps else EV, **_o)} SELECT * FROM viol")
    def _(spark, sf, gaps=_gaps, o=_o):
        limit = {"above" if o.get("above", True) else "below": o["limit"]}
        return D.violation(S.event_samples(spark, sf, gaps=gaps), **limit, min_duration=o.get("least", 0.0)).drop("signal")


@query(
    "violation_evidence",
    f"""WITH {violation_sql(EV, 60.0)}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "start") AS place FROM viol)
SELECT run_id, count(*) AS count, round(sum("end" - "start"), 6) AS total_duration, max(place) FILTER (place <= 256) AS listed FROM n GROUP BY run_id""",
)
def _(spark, sf):
    v = D.violation(S.event_samples(spark, sf), above=60.0).withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("start")))
    return v.groupBy("run_id").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("total_duration"), F.max(F.when(F.col("place") <= 256, F.col("place"))).alias("listed"))


TRANSITION_SQL = """d AS (SELECT *, lag(s) OVER w AS was, row_number() OVER w AS n, lead(idx) OVER w AS nx FROM b WINDOW w AS (PARTITION BY run_id ORDER BY idx))
SELECT run_id, idx, s AS state, was AS state_before, n > 1 AND s IS DISTINCT FROM was AS changed FROM d WHERE n = 1 OR nx IS NULL OR s IS DISTINCT FROM was"""


@query("state_transitions_event_type", f"WITH {EV}, b AS (SELECT run_id, idx, event_type AS s FROM ev), {TRANSITION_SQL}")
def _(spark, sf):
    df = S.event_samples(spark, sf, labels=True).where("signal = 'event_type'")
    return D.state_transitions(df).drop("signal", "t")


@query("state_transitions_conversations", f"WITH b AS (SELECT conv_id AS run_id, turn AS idx, role AS s FROM conversations), {TRANSITION_SQL}")
def _(spark, sf):
    c = S.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.lit("role").alias("signal"), F.col("turn").alias("idx"), F.col("turn").cast("double").alias("t"), F.col("role").alias("label"))
    return D.state_transitions(c).drop("signal", "t")


ORD = "ev AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx, epoch_us(o_orderdate) / 1e6 AS t, o_totalprice AS x, o_orderstatus AS s FROM orders)"


def _orders(spark, sf):
    return S.from_dataframe(S.table(spark, sf, "orders"), "o_custkey", S.seconds(F.col("o_orderdate")), {"totalprice": F.col("o_totalprice")}, ["o_orderkey"], {"status": F.col("o_orderstatus")})


@query("state_transitions_orders", f"WITH {ORD}, b AS (SELECT run_id, idx, s FROM ev), {TRANSITION_SQL}")
def _(spark, sf):
    return D.state_transitions(_orders(spark, sf).where("signal = 'status'")).drop("signal", "t")


@query(
    "transition_summary",
    f"""WITH {EV}, d AS (SELECT *, lag(event_type) OVER (PARTITION BY run_id ORDER BY idx) AS was FROM ev)
SELECT run_id, count(*) FILTER (was IS NOT NULL AND was <> event_type) AS transitions, count(DISTINCT event_type) AS distinct_count, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS distinct_values FROM d GROUP BY run_id""",
)
def _(spark, sf):
    return D.transition_summary(S.event_samples(spark, sf, labels=True).where("signal = 'event_type'")).drop("signal")


@query("extent", f"WITH {EV} SELECT run_id, min(idx) AS first_idx, arg_min(t, idx) AS first_t, max(idx) AS last_idx, arg_max(t, idx) AS last_t FROM ev GROUP BY run_id")
def _(spark, sf):
    return D.extent(S.event_samples(spark, sf)).drop("signal")


@query(
    "gap_retention",
    f"""WITH {EG}, d AS (SELECT run_id, idx, t, x IS NOT NULL AS fin, lag(x IS NOT NULL) OVER w AS p, lead(x IS NOT NULL) OVER w AS n FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx))
SELECT run_id, idx, t, fin FROM d WHERE (NOT fin AND (coalesce(p, true) OR coalesce(n, true))) OR (fin AND (p = false OR n = false))""",
)
def _(spark, sf):
    return D.gap_retention(S.event_samples(spark, sf, gaps=True)).drop("signal")


@query("run_starts", f"WITH {EV}, d AS (SELECT *, lag(x > 60) OVER (PARTITION BY run_id ORDER BY idx) AS was FROM ev) SELECT run_id, idx, t, was IS NULL AS at_start FROM d WHERE x > 60 AND NOT coalesce(was, false)")
def _(spark, sf):
    return D.run_starts(S.event_samples(spark, sf), F.col("x") > 60).drop("signal")


PEAK_SQL = """r0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR x IS DISTINCT FROM lag(x) OVER w THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY idx) AS k FROM r0), m0 AS (SELECT run_id, k, min(idx) AS i0, max(idx) AS i1, any_value(x) AS x FROM r1 GROUP BY run_id, k),
both_ AS (SELECT run_id, k, i0, i1, x, x AS y, 'max' AS kind FROM m0 UNION ALL SELECT run_id, k, i0, i1, x, -x, 'min' FROM m0),
c0 AS (SELECT *, lag(y) OVER w AS yp, lead(y) OVER w AS yn FROM both_ WINDOW w AS (PARTITION BY run_id, kind ORDER BY k)), c AS (SELECT * FROM c0 WHERE yp < y AND yn < y),
stops AS (SELECT c.run_id, c.kind, c.k, c.y, c.x, c.i0, c.i1, coalesce(max(o.k) FILTER (o.k < c.k), 0) AS lk, coalesce(min(o.k) FILTER (o.k > c.k), 1000000000) AS rk
 FROM c LEFT JOIN both_ o ON o.run_id = c.run_id AND o.kind = c.kind AND (o.y > c.y OR o.y IS NULL) GROUP BY ALL),
bases AS (SELECT s.run_id, s.kind, s.k, s.y, s.x, s.i0, s.i1, first(o.i1 ORDER BY o.y, o.k DESC) FILTER (o.k < s.k) AS left_base, min(o.y) FILTER (o.k < s.k) AS ly, first(o.i0 ORDER BY o.y, o.k) FILTER (o.k > s.k) AS right_base, min(o.y) FILTER (o.k > s.k) AS ry
 FROM stops s JOIN both_ o ON o.run_id = s.run_id AND o.kind = s.kind AND o.k > s.lk AND o.k < s.rk GROUP BY ALL)
SELECT run_id, (i0 + i1) // 2 AS idx, x AS value, y - greatest(ly, ry) AS prominence, kind, left_base, right_base FROM bases WHERE y - greatest(ly, ry) >= 60"""


@query("local_extrema_events", f"WITH {EV}, {PEAK_SQL}")
def _(spark, sf):
    return D.local_extrema(S.event_samples(spark, sf), 60.0).drop("signal")


@query("local_extrema_gaps", f"WITH {EG}, {PEAK_SQL}")
def _(spark, sf):
    return D.local_extrema(S.event_samples(spark, sf, gaps=True), 60.0).drop("signal")


@query("local_extrema_separation")
def _(spark, sf):
    return D.local_extrema(S.event_samples(spark, sf), 60.0, separation=5 * 86400.0).drop("signal")


TRIG = f"{crossing_sql(EV, 60.0, edge='rising')}, trig AS (SELECT run_id, tc AS t, row_number() OVER (PARTITION BY run_id ORDER BY tc) AS k FROM flips WHERE reported)"
for _name, _which, _where in (("all", "all", "true"), ("first", "first", "k = 1"), ("last", "last", "k = (SELECT max(k) FROM trig o WHERE o.run_id = trig.run_id)"), ("nth", 2, "k = 2")):

    @query(f"event_triggers_{_name}", f"WITH {TRIG} SELECT run_id, k, t FROM trig WHERE {_where}")
    def _(spark, sf, which=_which):
        return E.occurrence(E.crossing_event(S.event_samples(spark, sf), "high", 60.0, "rising"), which).drop("event")


@query(
    "event_triggers_equals",
    f"WITH {EV}, d AS (SELECT *, lag(event_type) OVER (PARTITION BY run_id ORDER BY idx) AS was FROM ev) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t) AS k, t FROM d WHERE event_type = 'purchase' AND was IS DISTINCT FROM 'purchase'",
)
def _(spark, sf):
    return E.equals_event(S.event_samples(spark, sf, labels=True).where("signal = 'event_type'"), "buy", F.col("label") == "purchase").drop("event")


@query(
    "event_windows",
    f"""WITH {TRIG}, n AS (SELECT run_id, idx, t, lag(t) OVER w AS tp, lead(t) OVER w AS tn FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx)), ends AS (SELECT run_id, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY run_id)
SELECT run_id, k, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS samples, any_value(trig.t - 86400 < t0 OR trig.t + 172800 > t1) AS clipped
FROM trig JOIN n USING (run_id) JOIN ends USING (run_id) WHERE k = 1 AND coalesce(n.tn, n.t) >= trig.t - 86400 AND coalesce(n.tp, n.t) <= trig.t + 172800 GROUP BY run_id, k""",
)
def _(spark, sf):
    s = S.event_samples(spark, sf)
    return E.windows(s, E.occurrence(E.crossing_event(s, "high", 60.0, "rising"), "first"), 86400.0, 172800.0).drop("signal")


# ---- resampling: values of all but errors, read at the times of errors
_GRID = f"WITH {EV}, s AS (SELECT run_id, idx, t, x FROM ev WHERE event_type <> 'error'), q AS (SELECT run_id, t FROM ev WHERE event_type = 'error')"


def _split(spark, sf):
    e = S.event_wide(spark, sf)
    return e.where("event_type <> 'error'").select("run_id", "idx", "t", F.col("value").alias("x")), e.where("event_type = 'error'").select("run_id", "t")


@query(
    "resample_linear",
    f"""{_GRID}, l AS (SELECT q.run_id, q.t, s.t AS ta, s.x AS xa FROM q ASOF LEFT JOIN s ON s.run_id = q.run_id AND s.t <= q.t), r AS (SELECT q.run_id, q.t, s.t AS tb, s.x AS xb FROM q ASOF LEFT JOIN s ON s.run_id = q.run_id AND s.t > q.t)
SELECT l.run_id, l.t, CASE WHEN ta = l.t THEN xa ELSE xa + (l.t - ta) / nullif(tb - ta, 0) * (xb - xa) END AS x FROM l JOIN r ON l.run_id = r.run_id AND l.t = r.t""",
)
def _(spark, sf):
    return R.resample_linear(*_split(spark, sf))


@query("resample_hold", f"{_GRID} SELECT q.run_id, q.t, s.x FROM q ASOF LEFT JOIN s ON s.run_id = q.run_id AND s.t <= q.t")
def _(spark, sf):
    return R.resample_hold(*_split(spark, sf))


@query("grid_union", "SELECT DISTINCT run_id, t FROM (SELECT user_id AS run_id, epoch_us(ts) / 1e6 AS t FROM events UNION ALL SELECT o_custkey, epoch_us(o_orderdate) / 1e6 FROM orders)")
def _(spark, sf):
    return R.grid_union(S.event_wide(spark, sf), _orders(spark, sf).where("signal = 'totalprice'"))


@query(
    "sync_groups",
    f"""WITH {EV}, m AS (SELECT run_id, event_type AS signal, row_number() OVER (PARTITION BY run_id, event_type ORDER BY idx) - 1 AS idx, t FROM ev), p AS (SELECT DISTINCT run_id, t FROM m WHERE signal = 'error'),
b AS (SELECT run_id, signal, min(t) AS t0, max(t) AS t1 FROM m GROUP BY ALL), a AS (SELECT p.run_id, signal, p.t, t0, t1 FROM p JOIN b USING (run_id)),
l AS (SELECT a.*, m.idx AS li, m.t AS lt FROM a ASOF LEFT JOIN m ON m.run_id = a.run_id AND m.signal = a.signal AND m.t <= a.t), r AS (SELECT a.run_id, a.signal, a.t, m.idx AS ri FROM a ASOF LEFT JOIN m ON m.run_id = a.run_id AND m.signal = a.signal AND m.t > a.t),
s AS (SELECT l.*, r.ri, CASE WHEN lt = l.t THEN 'aligned' WHEN l.t < t0 OR l.t > t1 THEN 'out_of_range' ELSE 'unaligned' END AS status FROM l JOIN r USING (run_id, signal, t))
SELECT run_id, signal, t, status, CASE WHEN status = 'aligned' THEN li END AS index, CASE WHEN status = 'unaligned' THEN li END AS index_before, CASE WHEN status = 'unaligned' THEN ri END AS index_after FROM s""",
)
def _(spark, sf):
    w = Window.partitionBy("run_id", "event_type").orderBy("idx")
    e = S.event_wide(spark, sf).select("run_id", F.col("event_type").alias("signal"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "t", F.col("value").alias("x"))
    return R.sync_groups(e, e.where("signal = 'error'"))


_CURVE = [(0.0, 1.0), (50.0, 3.0), (100.0, 2.0), (400.0, 8.0)]
for _name, _mode, _outside in (("curve_lookup", "linear", "hold"), ("curve_lookup_step", "step", "hold"), ("curve_lookup_none", "linear", "none")):

    def _curve_sql(mode, outside):
        parts = " ".join(f"WHEN x < {b[0]} THEN {a[1]}" + ("" if mode == "step" else f" + (x - {a[0]}) * {(b[1] - a[1]) / (b[0] - a[0])!r}::DOUBLE") for a, b in zip(_CURVE, _CURVE[1:]))
        return f"WITH {EV} SELECT run_id, idx, CASE WHEN x < {_CURVE[0][0]} THEN {_CURVE[0][1] if outside == 'hold' else 'NULL'} {parts} WHEN x = {_CURVE[-1][0]} THEN {_CURVE[-1][1]} ELSE {_CURVE[-1][1] if outside == 'hold' else 'NULL'} END::DOUBLE AS y FROM ev"

    @query(_name, _curve_sql(_mode, _outside))
    def _(spark, sf, mode=_mode, outside=_outside):
        return S.event_wide(spark, sf).select("run_id", "idx", R.curve(F.col("value"), _CURVE, mode, outside).alias("y"))


# ---- derived series and scalars
@query(
    "deriv_events",
    f"""WITH {EV}, n AS (SELECT run_id, idx, t, x, lag(t) OVER w AS tp, lag(x) OVER w AS xp, lead(t) OVER w AS tn, lead(x) OVER w AS xn FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx))
SELECT run_id, idx, round(CASE WHEN tp IS NULL THEN (xn - x) / (tn - t) WHEN tn IS NULL THEN (x - xp) / (t - tp)
ELSE ((t - tp) * (t - tp) * xn + ((tn - t) * (tn - t) - (t - tp) * (t - tp)) * x - (tn - t) * (tn - t) * xp) / ((t - tp) * (tn - t) * (tn - tp)) END, 9) AS dx FROM n""",
)
def _(spark, sf):
    return A.deriv(S.event_samples(spark, sf)).select("run_id", "idx", F.round("dx", 9).alias("dx"))


@query(
    "movmean_events",
    f"""WITH {EV}, p AS (SELECT run_id, idx, t, x, lag(t) OVER w AS tp, lag(x) OVER w AS xp FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
c AS (SELECT *, sum(coalesce((t - tp) * 0.5 * (x + xp), 0)) OVER (PARTITION BY run_id ORDER BY idx) AS i, sum(coalesce(t - tp, 0)) OVER (PARTITION BY run_id ORDER BY idx) AS u FROM p),
q AS (SELECT run_id, idx, t, x, i, u, greatest(t - 604800.0, min(t) OVER (PARTITION BY run_id)) AS tq FROM c),
l AS (SELECT q.*, c.t AS ta, c.i AS ia, c.u AS ua FROM q ASOF JOIN c ON c.run_id = q.run_id AND c.t <= q.tq), r AS (SELECT q.run_id, q.idx, c.t AS tb, c.i AS ib, c.u AS ub FROM q ASOF LEFT JOIN c ON c.run_id = q.run_id AND c.t > q.tq),
z AS (SELECT l.*, CASE WHEN ta = tq THEN ia ELSE ia + (tq - ta) / (tb - ta) * (ib - ia) END AS i0, CASE WHEN ta = tq THEN ua ELSE ua + (tq - ta) / (tb - ta) * (ub - ua) END AS u0 FROM l JOIN r USING (run_id, idx))
SELECT run_id, idx, round(CASE WHEN u - u0 > 0 THEN (i - i0) / (u - u0) ELSE x END, 6) AS mean FROM z""",
)
def _(spark, sf):
    return A.movmean(S.event_samples(spark, sf), 604800.0).select("run_id", "idx", F.round("mean", 6).alias("mean"))


_PAIR = f"WITH {EG}, n AS (SELECT run_id, idx, t, x, lead(t) OVER w AS tn, lead(x) OVER w AS xn FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx))"


@query("agg_max_min_initial_final", f"WITH {EG} SELECT run_id, max(x) AS max, min(x) AS min, first(x ORDER BY idx) FILTER (x IS NOT NULL) AS initial, last(x ORDER BY idx) FILTER (x IS NOT NULL) AS final FROM ev GROUP BY run_id")
def _(spark, sf):
    return A.scalars(S.event_samples(spark, sf, gaps=True)).select("run_id", "max", "min", "initial", "final")


@query(
    "agg_mean_rms_integral",
    f"""{_PAIR}, a AS (SELECT run_id, sum((tn - t) * 0.5 * (x + xn)) AS i, sum((tn - t) * (x * x + xn * xn + x * xn) / 3.0) AS s, sum(tn - t) FILTER (x IS NOT NULL AND xn IS NOT NULL) AS c, avg(x) AS m, avg(x * x) AS q FROM n GROUP BY run_id)
SELECT run_id, round(coalesce(i, 0), 3) AS integral, round(CASE WHEN c > 0 THEN i / c ELSE m END, 6) AS mean, round(sqrt(CASE WHEN c > 0 THEN s / c ELSE q END), 6) AS rms FROM a""",
)
def _(spark, sf):
    a = A.scalars(S.event_samples(spark, sf, gaps=True))
    return a.select("run_id", F.round("integral", 3).alias("integral"), F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"))


@query("agg_duration", f"{_PAIR} SELECT run_id, round(coalesce(sum(tn - t) FILTER (x > 50 AND xn > 50), 0), 6) AS continuous, round(coalesce(sum(tn - t) FILTER (x > 50), 0), 6) AS discrete FROM n GROUP BY run_id")
def _(spark, sf):
    s = S.event_samples(spark, sf, gaps=True)
    hit = F.col("x") > 50
    d = A.duration(s, hit).select("run_id", F.round("duration", 6).alias("continuous"))
    return d.join(A.duration(s, hit, discrete=True).select("run_id", F.round("duration", 6).alias("discrete")), "run_id")


@query("agg_times", f"WITH {EG} SELECT run_id, first(t ORDER BY x DESC, idx) FILTER (x IS NOT NULL) AS t_max, first(t ORDER BY x, idx) FILTER (x IS NOT NULL) AS t_min, min(t) FILTER (x IS NOT NULL) AS t_initial, max(t) FILTER (x IS NOT NULL) AS t_final FROM ev GROUP BY run_id")
def _(spark, sf):
    return A.scalars(S.event_samples(spark, sf, gaps=True)).select("run_id", "t_max", "t_min", "t_initial", "t_final")


_EVENTS2 = f"""WITH {TRIG}, buy AS (SELECT run_id, list(t ORDER BY t) AS b FROM (SELECT run_id, t, event_type, lag(event_type) OVER (PARTITION BY run_id ORDER BY idx) AS was FROM ev) WHERE event_type = 'purchase' AND was IS DISTINCT FROM 'purchase' GROUP BY run_id),
hi AS (SELECT run_id, list(t ORDER BY t) AS h FROM trig GROUP BY run_id), j AS (SELECT ev.run_id, idx, t, x, coalesce(h, []) AS h, coalesce(b, []) AS b FROM ev LEFT JOIN hi USING (run_id) LEFT JOIN buy USING (run_id))"""


def _attached(spark, sf):
    s = S.event_samples(spark, sf)
    types = S.event_samples(spark, sf, labels=True).where("signal = 'event_type'")
    high = E.crossing_event(s, "high", 60.0, "rising")
    return E.attach(s, {"high": high, "buy": E.equals_event(types, "buy", F.col("label") == "purchase")})


@query(
    "after_before_during_between",
    f"""{_EVENTS2} SELECT run_id, idx, coalesce(t >= h[1] + 3600, false) AS after, coalesce(t < h[1], true) AS before, coalesce(t >= h[1] AND t < h[1] + 864000, false) AS during,
len(list_filter(h, lambda a: t >= a AND t < a + 86400)) > 0 AS during_all, len(list_filter(h, lambda a: t >= a AND coalesce(t < list_min(list_filter(b, lambda e: e >= a)), true))) > 0 AS between FROM j""",
)
def _(spark, sf):
    t, high, buy = F.col("t"), F.col("e_high"), F.col("e_buy")
    one = F.slice(high, 1, 1)
    return _attached(spark, sf).select("run_id", "idx", E.after(t, one, 3600.0).alias("after"), E.before(t, one).alias("before"), E.during(t, one, 864000.0).alias("during"), E.during(t, high, 86400.0).alias("during_all"), E.between(t, high, buy).alias("between"))


@query("since_time_count", f"{_EVENTS2} SELECT run_id, idx, CASE WHEN t >= h[1] THEN t - h[1] END AS since, h[1] AS time, len(h)::INT AS count, h[2] AS second FROM j")
def _(spark, sf):
    t, high = F.col("t"), F.col("e_high")
    return _attached(spark, sf).select("run_id", "idx", E.since(t, high).alias("since"), E.first(high).alias("time"), F.size(high).alias("count"), E.nth(high, 2).alias("second"))


@query(
    "event_at",
    f"""WITH {TRIG}, g AS (SELECT run_id, t FROM trig WHERE k = 1), le AS (SELECT g.run_id, g.t, ev.t AS ta, ev.x AS xa FROM g ASOF LEFT JOIN ev ON ev.run_id = g.run_id AND ev.t <= g.t), ri AS (SELECT g.run_id, ev.t AS tb, ev.x AS xb FROM g ASOF LEFT JOIN ev ON ev.run_id = g.run_id AND ev.t > g.t)
SELECT le.run_id, t, CASE WHEN ta = t THEN xa ELSE xa + (t - ta) / nullif(tb - ta, 0) * (xb - xa) END AS x FROM le JOIN ri USING (run_id)""",
)
def _(spark, sf):
    s = S.event_samples(spark, sf)
    return R.resample_linear(s, E.occurrence(E.crossing_event(s, "high", 60.0, "rising"), "first"))


# ---- sets of samples, previews, budgets
_KEEP = "hit AS (SELECT run_id, idx, CASE WHEN x > 100 THEN 4 ELSE 0 END + CASE WHEN idx = 0 OR idx = max(idx) OVER (PARTITION BY run_id) THEN 1 ELSE 0 END + CASE WHEN x < 5 THEN 8 ELSE 0 END AS roles FROM ev), kept AS (SELECT * FROM hit WHERE roles > 0)"


def _retained(spark, sf):
    s = S.event_samples(spark, sf)
    e = D.extent(s)
    parts = [s.where("x > 100").select("run_id", "signal", "idx", F.lit(4).cast("long").alias("roles")), s.where("x < 5").select("run_id", "signal", "idx", F.lit(8).cast("long").alias("roles"))]
    parts += [e.select("run_id", "signal", F.col(c).alias("idx"), F.lit(1).cast("long").alias("roles")) for c in ("first_idx", "last_idx")]
    return P.union_roles(*parts)


@query("retained_union_roles", f"WITH {EV}, {_KEEP} SELECT run_id, idx, roles FROM kept")
def _(spark, sf):
    return _retained(spark, sf).drop("signal")


@query("retained_ranges", f"WITH {EV}, {_KEEP}, g AS (SELECT *, idx - row_number() OVER (PARTITION BY run_id ORDER BY idx) AS k FROM kept) SELECT run_id, min(idx) AS start, max(idx) + 1 AS stop FROM g GROUP BY run_id, k")
def _(spark, sf):
    return P.ranges(_retained(spark, sf)).drop("signal")


@query("retained_difference", f"WITH {EV}, {_KEEP} SELECT run_id, idx FROM ev WHERE x > 50 EXCEPT SELECT run_id, idx FROM kept")
def _(spark, sf):
    s = S.event_samples(spark, sf)
    return s.where("x > 50").join(_retained(spark, sf), ["run_id", "signal", "idx"], "left_anti").select("run_id", "idx")


@query(
    "reconstruction_error",
    f"""WITH {EV}, {_KEEP}, f AS (SELECT ev.run_id, ev.idx, ev.t, ev.x, kept.idx IS NOT NULL AS k FROM ev LEFT JOIN kept USING (run_id, idx)), kn AS (SELECT * FROM f WHERE k),
l AS (SELECT f.*, kn.t AS ta, kn.x AS xa FROM f ASOF JOIN kn ON kn.run_id = f.run_id AND kn.idx <= f.idx), r AS (SELECT l.*, kn.t AS tb, kn.x AS xb FROM l ASOF JOIN kn ON kn.run_id = l.run_id AND kn.idx >= l.idx)
SELECT run_id, max(abs(x - coalesce(xa + (t - ta) / nullif(tb - ta, 0) * (xb - xa), xa))) FILTER (NOT k) AS max_error, count(*) FILTER (k) AS retained, count(*) AS samples FROM r GROUP BY run_id""",
)
def _(spark, sf):
    return R.reconstruction_error(S.event_samples(spark, sf), _retained(spark, sf)).drop("signal")


_BINS = "bins AS (SELECT run_id, idx, x, ((idx + 1) * 8 - 1) // count(*) OVER (PARTITION BY run_id) AS bin FROM ev)"


@query("equal_count_bins", f"WITH {EV}, {_BINS} SELECT run_id, bin, first(idx ORDER BY x, idx) AS min_idx, min(x) AS min_value, first(idx ORDER BY x DESC, idx) AS max_idx, max(x) AS max_value FROM bins WHERE x IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return P.equal_count_bins(S.event_samples(spark, sf), 8).drop("signal")


RANK = f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM ev), lev AS (SELECT unnest(range(0, 4)) AS level), b AS (SELECT run_id, level, idx, x, ((idx + 1) * (1 << level) - 1) // n AS bin FROM n, lev),
g AS (SELECT run_id, level, bin, max(x) - min(x) AS span, first(idx ORDER BY x, idx) AS lo, first(idx ORDER BY x DESC, idx) AS hi FROM b WHERE x IS NOT NULL GROUP BY ALL),
c AS (SELECT run_id, level, -span AS s, bin, unnest([0, 1]) AS side, unnest([lo, hi]) AS idx FROM g), f AS (SELECT run_id, idx, min((level, s, bin, side)) AS key FROM c GROUP BY ALL)
SELECT run_id, idx, row_number() OVER (PARTITION BY run_id ORDER BY key) AS rank FROM f"""


@query("preview_rank", RANK)
def _(spark, sf):
    return P.preview_rank(S.event_samples(spark, sf), levels=3).drop("signal")


@query("soft_allocation", f"SELECT * FROM ({RANK}) WHERE rank <= least(6, floor(2.5 * 2))")
def _(spark, sf):
    return P.soft_allocation(P.preview_rank(S.event_samples(spark, sf), levels=3), scale=2.5, weight=2.0, cap=6).drop("signal")


@query("budget_prefix", f"SELECT run_id, count(*) AS kept, sum(24)::BIGINT AS bytes FROM ({RANK}) WHERE rank * 24 <= 200 GROUP BY run_id")
def _(spark, sf):
    kept = P.budget_prefix(P.preview_rank(S.event_samples(spark, sf), levels=3).withColumn("bytes", F.lit(24)), 200, ["run_id"])
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("bytes").alias("bytes"))


@query("bit_reversed_order", f"WITH {EV}, w AS (SELECT run_id, idx, greatest(1, ceil(log2(count(*) OVER (PARTITION BY run_id)))::INT) AS w FROM ev) SELECT run_id, idx, list_sum(list_transform(range(0, w), lambda b: ((idx >> b) & 1) << (w - 1 - b)))::BIGINT AS reversed FROM w")
def _(spark, sf):
    return P.bit_reversed(S.event_samples(spark, sf)).select("run_id", "idx", "reversed")


@query(
    "envelope_bins",
    f"""WITH {EV}, e AS (SELECT *, min(t) OVER (PARTITION BY run_id) AS a, max(t) OVER (PARTITION BY run_id) AS b FROM ev), q AS (SELECT run_id, x, least(floor((t - a) / nullif(b - a, 0) * 16), 15)::BIGINT AS bin FROM e),
g AS (SELECT run_id, bin, min(x) AS lo, max(x) AS hi FROM q GROUP BY ALL), s AS (SELECT *, min(lo) OVER (PARTITION BY run_id) AS l, max(hi) OVER (PARTITION BY run_id) AS h FROM g)
SELECT run_id, bin, lo, hi, round_even((lo - l) / nullif(h - l, 0) * 254, 0)::INT AS lo_q, round_even((hi - l) / nullif(h - l, 0) * 254, 0)::INT AS hi_q FROM s""",
)
def _(spark, sf):
    return P.quantise(P.envelopes(S.event_samples(spark, sf), 16)).drop("signal")


@query(
    "batch_bands",
    f"""WITH {EV}, e AS (SELECT *, min(t) OVER (PARTITION BY run_id) AS a, max(t) OVER (PARTITION BY run_id) AS b FROM ev), q AS (SELECT run_id, x, least(floor((t - a) / nullif(b - a, 0) * 16), 15)::BIGINT AS bin FROM e),
g AS (SELECT run_id, bin, min(x) AS lo, max(x) AS hi FROM q GROUP BY ALL) SELECT bin, min(lo) AS lo, round(quantile_cont((lo + hi) / 2, 0.05), 9) AS p05, round(quantile_cont((lo + hi) / 2, 0.5), 9) AS p50, round(quantile_cont((lo + hi) / 2, 0.95), 9) AS p95, max(hi) AS hi FROM g GROUP BY bin""",
)
def _(spark, sf):
    return P.bands(P.envelopes(S.event_samples(spark, sf), 16))


@query("advice_steps", f"WITH {EV}, d AS (SELECT run_id, x, t - lag(t) OVER (PARTITION BY run_id ORDER BY idx) AS dt FROM ev) SELECT run_id, round(quantile_cont(dt, 0.5), 6) AS median_step, max(x) - min(x) AS value_range FROM d GROUP BY run_id")
def _(spark, sf):
    return P.advice(S.event_samples(spark, sf)).select("run_id", F.round("median_step", 6).alias("median_step"), "value_range")


@query("verify_redetect", f"WITH {crossing_sql(EG, 50.0, h=20.0, d=86400.0)} SELECT run_id, count(*) FILTER (reported) AS claimed, count(*) FILTER (reported) AS found, 0::BIGINT AS unmatched FROM flips GROUP BY run_id")
def _(spark, sf):
    s = S.event_samples(spark, sf, gaps=True)
    return P.verify_crossings(s, 50.0, hysteresis=20.0, debounce=86400.0)
