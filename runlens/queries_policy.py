"""Registered queries of policies, verification and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runlens import samples as S
from runlens.plans import compile as plan
from runlens.plans import policy
from runlens.queries_signals import EG, EV, crossing_sql
from runlens.session import shared_dir
from runlens.streaming.detect import stream_crossings, stream_window_extrema

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


DOCUMENT = """
version: 1
hard:
  value:
    global_extrema: {}
    violation: {above: 100 m, min_duration: 6 h}
  event_type:
    state_transitions: {}
soft:
  - {match: "*", importance: none}
"""
UNITS = {"value": "m"}
KEPT = f"""{EV}, sig AS (SELECT run_id, 'value' AS signal, idx FROM ev UNION ALL SELECT run_id, 'event_type', idx FROM ev),
d AS (SELECT *, x > 100 AS hit, lag(x) OVER w AS px, lag(t) OVER w AS pt, lead(x) OVER w AS nx, lead(t) OVER w AS nt, max(idx) OVER (PARTITION BY run_id) AS n, lag(event_type) OVER w AS was FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY run_id, hit ORDER BY idx) AS k FROM d),
o AS (SELECT run_id, k, min(idx) AS a, max(idx) AS z, first(idx ORDER BY x DESC, idx) AS w, any_value(n) AS n, last(CASE WHEN nx IS NULL THEN t ELSE least(greatest(t + (nt - t) * (100 - x) / nullif(nx - x, 0), t), nt) END ORDER BY idx) - first(CASE WHEN px IS NULL THEN t ELSE least(greatest(pt + (t - pt) * (100 - px) / nullif(x - px, 0), pt), t) END ORDER BY idx) AS len FROM g WHERE hit GROUP BY run_id, k),
kept AS (SELECT run_id, signal, min(idx) AS idx, 'extent' AS role FROM sig GROUP BY ALL UNION SELECT run_id, signal, max(idx), 'extent' FROM sig GROUP BY ALL
UNION SELECT run_id, 'value', first(idx ORDER BY x DESC, idx), 'hard.value.global_extrema#max' FROM ev GROUP BY run_id UNION SELECT run_id, 'value', first(idx ORDER BY x, idx), 'hard.value.global_extrema#min' FROM ev GROUP BY run_id
UNION SELECT run_id, 'value', i, 'hard.value.violation#edge' FROM (SELECT run_id, n, unnest([a - 1, a, z, z + 1]) AS i FROM o) WHERE i BETWEEN 0 AND n UNION SELECT run_id, 'value', w, 'hard.value.violation#worst' FROM o WHERE len >= 21600
UNION SELECT run_id, 'event_type', idx, 'hard.event_type.state_transitions' FROM d WHERE idx = 0 OR idx = n OR event_type IS DISTINCT FROM was
UNION SELECT run_id, 'event_type', idx, 'gap' FROM d WHERE idx = 0 OR idx = n)"""


def _samples(spark, sf):
    return S.event_samples(spark, sf, labels=True)


def _policy(document: str = DOCUMENT, **more) -> policy.Policy:
    return policy.load(document, ["event_type", "value"], UNITS, **more)


@query("policy_retained", f"WITH {KEPT} SELECT run_id, signal, idx, role FROM kept WHERE role <> 'gap'")
def _(spark, sf):
    return plan.compile_runs(_samples(spark, sf), _policy()).retained.where("role <> 'gap'")


@query("policy_bytes", f"WITH {KEPT}, u AS (SELECT DISTINCT run_id, signal, idx FROM kept) SELECT run_id, count(*) * 24 AS bytes, count(*) * 24 <= 3000 AS fits FROM u GROUP BY run_id")
def _(spark, sf):
    return plan.compile_runs(_samples(spark, sf), _policy(max_size=3000)).budget.select("run_id", "bytes", "fits")


@query("policy_evidence", f"WITH {KEPT} SELECT run_id, 'hard.value.violation' AS requirement, count(*) AS count FROM o WHERE len >= 21600 GROUP BY run_id UNION ALL SELECT run_id, 'hard.value.global_extrema', 1 FROM ev GROUP BY run_id UNION ALL SELECT run_id, 'hard.event_type.state_transitions', count(*) FROM d WHERE was IS NOT NULL AND was <> event_type GROUP BY run_id")
def _(spark, sf):
    return plan.compile_runs(_samples(spark, sf), _policy()).evidence.select("run_id", "requirement", "count")


CROSSING = DOCUMENT.replace("    violation: {above: 100 m, min_duration: 6 h}", "    threshold_crossing: {value: 50 m, hysteresis: 20 m, debounce: 1 d}\n    violation: {above: 100 m}")


@query("policy_verify", f"WITH {EV} SELECT DISTINCT run_id, \"check\", true AS ok FROM ev, (SELECT unnest(['source.samples', 'structure.extent', 'hard.value.global_extrema', 'hard.value.threshold_crossing', 'hard.value.violation', 'hard.event_type.state_transitions', 'budget.size']) AS \"check\")")
def _(spark, sf):
    s, p = _samples(spark, sf), _policy(CROSSING, max_size="4 KB")
    return plan.verify_runs(s, plan.compile_runs(s, p), p)


@query(
    "policy_verify_damaged",
    f"""WITH {EV} SELECT DISTINCT run_id, "check", CASE "check" WHEN 'source.samples' THEN md5(CAST(run_id AS VARCHAR)) < 'c'
WHEN 'hard.value.global_extrema' THEN md5(CAST(run_id AS VARCHAR)) >= '8' ELSE true END AS ok
FROM ev, (SELECT unnest(['source.samples', 'hard.value.global_extrema', 'budget.size']) AS "check")""",
)
def _(spark, sf):
    """Some runs have lost the sample of their maximum, others have one that the source has not: both must be told."""
    s, p = _samples(spark, sf), _policy(max_size="4 KB")
    compiled = plan.compile_runs(s, p)
    mark = F.md5(F.col("run_id").cast("string").cast("binary"))
    lost = compiled.retained.where((F.col("role") == "hard.value.global_extrema#max") & (mark < "8")).select("run_id", "signal", "idx")
    more = s.where(mark >= "c").groupBy("run_id", "signal").agg((F.max("idx") + 7).cast("long").alias("idx")).withColumn("role", F.lit("soft"))
    compiled.retained = compiled.retained.join(lost, ["run_id", "signal", "idx"], "left_anti").unionByName(more)
    found = plan.verify_runs(s, compiled, p)
    return found.where(F.col("check").isin("source.samples", "hard.value.global_extrema", "budget.size"))


@query("policy_events", f"WITH {crossing_sql(EV, 60.0, edge='rising')} SELECT run_id, count(*) AS count, CASE WHEN count(*) = 5 THEN 'pass' ELSE 'warn' END AS status FROM flips WHERE reported GROUP BY run_id")
def _(spark, sf):
    p = _policy(DOCUMENT.replace("hard:", "events:\n  high: {signal: value, rises_above: 60 m, occurrence: all, expect: 5, keep: {before: 3600, after: 3600, signals: [value]}}\nhard:"))
    return plan.compile_runs(_samples(spark, sf), p).evidence.where("requirement = 'events.high'").select("run_id", "count", "status")


@query("policy_minimum", f"WITH {KEPT}, u AS (SELECT DISTINCT run_id, signal, idx, regexp_replace(role, '#.*', '') AS requirement FROM kept WHERE role LIKE 'hard%') SELECT run_id, requirement, count(*) AS samples, count(*) * 24 AS bytes FROM u GROUP BY ALL")
def _(spark, sf):
    return plan.minimum(_samples(spark, sf), _policy())


@query("policy_manifest")
def _(spark, sf):
    s = S.event_samples(spark, sf)
    p = policy.load("version: 1\nhard: {value: {global_extrema: {}}}\nbudget: {max_size: 600 B}", ["value"], UNITS)
    return plan.manifest(s, plan.compile_runs(s, p), p)


@query("policy_relaxations")
def _(spark, sf):
    s = S.event_samples(spark, sf)
    return plan.relaxations(s, policy.load("version: 1\nhard: {value: {local_extrema: {prominence: 60 m}, violation: {above: 100 m, min_duration: 6 h}}}", ["value"], UNITS))


def _streamed(spark, sf, make, mode: str):
    """Runs a stream over the samples to its end and gives what it has told, from files: the driver holds no rows.

    All files of the samples are one batch, so that a signal comes in its order. In complete mode the last batch has told everything.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    s = S.event_samples(spark, sf, gaps=True).withColumn("ts", F.timestamp_seconds("t"))
    s.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(s.schema).parquet(f"{folder}/in")
    told = {}

    def keep(batch, number: int) -> None:
        told["last"] = f"{folder}/out/{number}"
        batch.write.mode("overwrite").parquet(told["last"])

    q = make(stream).writeStream.queryName(f"stream_{uuid.uuid4().hex}").outputMode(mode).option("checkpointLocation", f"{folder}/state")
    q = q.format("parquet").option("path", f"{folder}/out") if mode == "append" else q.foreachBatch(keep)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out" if mode == "append" else told["last"])


@query("stream_crossings", f"WITH {crossing_sql(EG, 50.0, h=20.0)} SELECT run_id, tc AS crossing, CASE WHEN state THEN 'rising' ELSE 'falling' END AS edge, before AS index_before, after AS index_after, confirm FROM flips WHERE reported")
def _(spark, sf):
    return _streamed(spark, sf, lambda s: stream_crossings(s, 50.0, hysteresis=20.0), "append").drop("signal")


@query("stream_window_extrema", f"WITH {EG} SELECT run_id, floor(t / 86400)::BIGINT AS day, max(x) AS max_value, min(x) AS min_value, count(*) AS n FROM ev WHERE x IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    out = _streamed(spark, sf, lambda s: stream_window_extrema(s, "1 day", "1 hour"), "complete")
    return out.select("run_id", F.floor(F.unix_micros("window.start") / 1e6 / 86400).alias("day"), F.col("hi.x").alias("max_value"), F.col("lo.x").alias("min_value"), "n")
