"""Units with factors to SI, quantities, and the rules by which expressions combine them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

#: Unit, dimension, factor to SI, offset to SI (absolute temperatures only).
UNITS: dict[str, tuple[str, float, float]] = {
    "": ("1", 1.0, 0.0), "1": ("1", 1.0, 0.0), "-": ("1", 1.0, 0.0), "%": ("1", 0.01, 0.0),
    "s": ("time", 1.0, 0.0), "ms": ("time", 1e-3, 0.0), "us": ("time", 1e-6, 0.0), "ns": ("time", 1e-9, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "d": ("time", 86400.0, 0.0),
    "m": ("length", 1.0, 0.0), "km": ("length", 1e3, 0.0), "cm": ("length", 1e-2, 0.0), "mm": ("length", 1e-3, 0.0), "ft": ("length", 0.3048, 0.0), "in": ("length", 0.0254, 0.0), "nmi": ("length", 1852.0, 0.0),
    "m/s": ("speed", 1.0, 0.0), "km/s": ("speed", 1e3, 0.0), "km/h": ("speed", 1 / 3.6, 0.0), "ft/s": ("speed", 0.3048, 0.0), "kn": ("speed", 1852 / 3600, 0.0),
    "m/s^2": ("acceleration", 1.0, 0.0), "g0": ("acceleration", 9.80665, 0.0), "ft/s^2": ("acceleration", 0.3048, 0.0),
    "kg": ("mass", 1.0, 0.0), "g": ("mass", 1e-3, 0.0), "t": ("mass", 1e3, 0.0), "lb": ("mass", 0.45359237, 0.0),
    "N": ("force", 1.0, 0.0), "kN": ("force", 1e3, 0.0), "MN": ("force", 1e6, 0.0), "lbf": ("force", 4.4482216152605, 0.0),
    "Pa": ("pressure", 1.0, 0.0), "hPa": ("pressure", 100.0, 0.0), "kPa": ("pressure", 1e3, 0.0), "MPa": ("pressure", 1e6, 0.0), "bar": ("pressure", 1e5, 0.0), "mbar": ("pressure", 100.0, 0.0), "psi": ("pressure", 6894.757293168361, 0.0), "atm": ("pressure", 101325.0, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5 / 9, 459.67 * 5 / 9),
    "rad": ("angle", 1.0, 0.0), "deg": ("angle", math.pi / 180, 0.0), "rad/s": ("angular rate", 1.0, 0.0), "deg/s": ("angular rate", math.pi / 180, 0.0), "rpm": ("angular rate", math.pi / 30, 0.0),
    "Hz": ("frequency", 1.0, 0.0), "kHz": ("frequency", 1e3, 0.0), "V": ("voltage", 1.0, 0.0), "mV": ("voltage", 1e-3, 0.0), "A": ("current", 1.0, 0.0), "mA": ("current", 1e-3, 0.0),
    "W": ("power", 1.0, 0.0), "kW": ("power", 1e3, 0.0), "J": ("energy", 1.0, 0.0), "kJ": ("energy", 1e3, 0.0), "Nm": ("torque", 1.0, 0.0), "kg/s": ("mass flow", 1.0, 0.0), "Pa/s": ("pressure rate", 1.0, 0.0), "N/s": ("force rate", 1.0, 0.0), "K/s": ("temperature rate", 1.0, 0.0),
}
#: What the derivative over time of a unit is measured in.
DERIVATIVES = {"m": "m/s", "m/s": "m/s^2", "rad": "rad/s", "deg": "deg/s", "kg": "kg/s", "Pa": "Pa/s", "N": "N/s", "K": "K/s", "J": "W", "1": "Hz"}
INTEGRALS = {v: k for k, v in DERIVATIVES.items()}
_NUMBER = re.compile(r"\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*\[?\s*([^\]\s]*)\s*\]?\s*$")


class UnitError(ValueError):
    """Units that are unknown or don't go together."""


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: str | None = None


class Units:
    """The table above with units of one's own, each defined by a quantity in known units."""

    def __init__(self, own: dict[str, str] | None = None):
        self.table = dict(UNITS)
        for name, text in (own or {}).items():
            q = self.parse(text)
            dimension, factor, offset = self.table[q.unit or "1"]
            if offset:
                raise UnitError(f"{name}: a unit with an offset can't be the base of another")
            self.table[name] = (dimension, factor * q.value, 0.0)

    def parse(self, text: str) -> Quantity:
        m = _NUMBER.match(str(text))
        if not m:
            raise UnitError(f"{text!r} isn't a number with a unit")
        unit = m[2] or None
        if unit and unit not in self.table:
            raise UnitError(f"unknown unit {unit!r}")
        return Quantity(float(m[1]), unit)

    def factor(self, source: str, target: str, difference: bool = True) -> tuple[float, float]:
        """(factor, offset) from one unit to another; offsets only for absolute values."""
        for u in (source, target):
            if u not in self.table:
                raise UnitError(f"unknown unit {u!r}")
        (d1, f1, o1), (d2, f2, o2) = self.table[source], self.table[target]
        if d1 != d2:
            raise UnitError(f"{source} and {target} measure different things")
        return f1 / f2, 0.0 if difference else (o1 - o2) / f2

    def convert(self, value: float, source: str, target: str, difference: bool = False) -> float:
        f, o = self.factor(source, target, difference)
        return value * f + o

    def seconds(self, text: str) -> float:
        q = self.parse(text)
        return self.convert(q.value, q.unit or "s", "s")

    def affine(self, unit: str) -> bool:
        return self.table[unit][2] != 0.0
