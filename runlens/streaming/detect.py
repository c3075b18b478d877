"""The detectors as streams: tumbling extrema with a watermark, and the crossing machine with state for each signal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "seen boolean, state boolean, initial boolean, held boolean, t double, x double, idx long, up_t double, up_before long, up_after long, down_t double, down_before long, down_after long, flip_state boolean, flip_t double, flip_before long, flip_after long, flip_confirm long"
_OUT = "run_id {run}, signal string, crossing double, edge string, index_before long, index_after long, confirm long"


def stream_window_extrema(samples: DataFrame, interval: str, delay: str) -> DataFrame:
    """Extrema of tumbling windows over `ts` (a timestamp), final when the watermark has passed."""
    late = samples.withWatermark("ts", delay).where("x is not null")
    return late.groupBy("run_id", "signal", F.window("ts", interval)).agg(F.max(F.struct("x", (-F.col("idx")).alias("i"))).alias("hi"), F.min(F.struct("x", "idx")).alias("lo"), F.count(F.lit(1)).alias("n"))


def stream_crossings(samples: DataFrame, value: float, hysteresis: float = 0.0, debounce: float = 0.0, edge: str = "both") -> DataFrame:
    """Crossings as samples arrive in order of idx within each signal. A flip is told when its run has lasted long enough.

    Non-finite samples hold the state. A last flip that has not lasted yet stays pending in the state.
    """
    hi, lo = value + hysteresis / 2, value - hysteresis / 2

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATE.split(", ")]
        s = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
        out = []

        def settle(end: float) -> None:
            """The pending flip has lasted to `end`."""
            if s["flip_t"] is None or end - s["flip_t"] < debounce:
                return
            if s["flip_state"] != s["held"] and (edge == "both" or (edge == "rising") == s["flip_state"]):
                out.append((*key, s["flip_t"], "rising" if s["flip_state"] else "falling", s["flip_before"], s["flip_after"], s["flip_confirm"]))
            s["held"], s["flip_t"] = s["flip_state"], None

        rows = pd.concat(list(batches)).sort_values("idx")
        for t, x, idx in zip(rows.t, rows.x, rows.idx):
            if pd.isna(x):
                continue
            t, x, idx = float(t), float(x), int(idx)
            if not s["seen"]:
                s |= {"seen": True, "state": x >= value, "initial": x >= value, "held": x >= value, "t": t, "x": x, "idx": idx}
                continue
            if (s["x"] < value) != (x < value):
                tc = min(max(s["t"] + (t - s["t"]) * (value - s["x"]) / (x - s["x"]), s["t"]), t)
                side = "up" if x >= value else "down"
                s |= {f"{side}_t": tc, f"{side}_before": s["idx"], f"{side}_after": idx}
            new = True if x >= hi else False if x <= lo and x < value else s["state"]
            if new != s["state"]:
                side = "up" if new else "down"
                settle(s[f"{side}_t"])
                s |= {"state": new, "flip_state": new, "flip_t": s[f"{side}_t"], "flip_before": s[f"{side}_before"], "flip_after": s[f"{side}_after"], "flip_confirm": idx}
            s |= {"t": t, "x": x, "idx": idx}
            settle(t)
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame(out, columns=["run_id", "signal", "crossing", "edge", "index_before", "index_after", "confirm"])

    schema = _OUT.format(run=dict(samples.dtypes)["run_id"])
    return samples.groupBy("run_id", "signal").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
