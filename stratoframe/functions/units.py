"""Linear unit conversions, each as (scale, offset) to a base unit."""

from __future__ import annotations

#: Unit -> (base unit, scale, offset).
UNITS = {
    "K": ("K", 1.0, 0.0), "degC": ("K", 1.0, 273.15), "C": ("K", 1.0, 273.15), "degF": ("K", 5 / 9, 459.67 * 5 / 9), "F": ("K", 5 / 9, 459.67 * 5 / 9),
    "Pa": ("Pa", 1.0, 0.0), "hPa": ("Pa", 100.0, 0.0), "kPa": ("Pa", 1000.0, 0.0), "mbar": ("Pa", 100.0, 0.0),
    "m": ("m", 1.0, 0.0), "km": ("m", 1000.0, 0.0), "cm": ("m", 0.01, 0.0), "mm": ("m", 0.001, 0.0),
    "m/s": ("m/s", 1.0, 0.0), "km/h": ("m/s", 1 / 3.6, 0.0), "knot": ("m/s", 1852 / 3600, 0.0),
    "kg": ("kg", 1.0, 0.0), "g": ("kg", 0.001, 0.0), "1": ("1", 1.0, 0.0), "%": ("1", 0.01, 0.0),
    "s": ("s", 1.0, 0.0), "h": ("s", 3600.0, 0.0), "d": ("s", 86400.0, 0.0),
}


def conversion(source: str, target: str) -> tuple[float, float]:
    """(a, b) with target = a * source + b."""
    (base, s, o), (other, t, p) = UNITS[source], UNITS[target]
    if base != other:
        raise ValueError(f"{source} isn't convertible to {target}")
    return s / t, (o - p) / t


def same(one: str, other: str) -> bool:
    """Whether two names are of one unit."""
    return one == other or (one in UNITS and other in UNITS and UNITS[one] == UNITS[other])
