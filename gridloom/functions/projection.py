"""Swiss LV95 (EPSG:2056) and WGS84 (EPSG:4326) as column expressions.

The Swiss grid is an oblique conformal cylinder on the Bessel ellipsoid: ellipsoid to sphere, sphere
turned to the projection's equator, Mercator.  The datum shift is a translation of geocentric
coordinates.  Heights are taken as 0 on either ellipsoid, so a point comes back within 2 mm.

The steps are expressions that Spark and other SQL engines read alike.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bessel 1841 and WGS84 (axis, squared eccentricity), the projection's origin and the datum shift in metres.
BESSEL = (6377397.155, 0.006674372230614)
WGS84 = (6378137.0, 0.0066943799901413165)
PHI0, LAMBDA0 = math.radians(46 + 57 / 60 + 8.66 / 3600), math.radians(7 + 26 / 60 + 22.50 / 3600)
FALSE_EAST, FALSE_NORTH = 2600000.0, 1200000.0
SHIFT = (674.374, 15.056, 405.346)

_E = math.sqrt(BESSEL[1])
_RADIUS = BESSEL[0] * math.sqrt(1 - BESSEL[1]) / (1 - BESSEL[1] * math.sin(PHI0) ** 2)
_ALPHA = math.sqrt(1 + BESSEL[1] / (1 - BESSEL[1]) * math.cos(PHI0) ** 4)
_B0 = math.asin(math.sin(PHI0) / _ALPHA)


def _isometric(phi: float) -> float:
    return math.log(math.tan(math.pi / 4 + phi / 2)) - _E / 2 * math.log((1 + _E * math.sin(phi)) / (1 - _E * math.sin(phi)))


_K = math.log(math.tan(math.pi / 4 + _B0 / 2)) - _ALPHA * _isometric(PHI0)


class Steps:
    """Named steps of a computation; each is one expression over the names before it."""

    def __init__(self):
        self.steps: list[tuple[str, str]] = []

    def add(self, name: str, expression: str) -> str:
        # Numbers with an exponent are doubles, others would be decimals.
        self.steps.append((name, re.sub(r"(?<![\w.])(\d+\.\d+)(?![\d.e])", r"\1e0", expression)))
        return name


def _to_geocentric(s: Steps, lon: str, lat: str, ellipsoid: tuple[float, float], tag: str) -> None:
    a, e2 = ellipsoid
    s.add(f"v{tag}", f"{a!r} / sqrt(1 - {e2!r} * pow(sin({lat}), 2))")
    s.add(f"x{tag}", f"v{tag} * cos({lat}) * cos({lon})")
    s.add(f"y{tag}", f"v{tag} * cos({lat}) * sin({lon})")
    s.add(f"z{tag}", f"v{tag} * (1 - {e2!r}) * sin({lat})")


def _from_geocentric(s: Steps, x: str, y: str, z: str, ellipsoid: tuple[float, float], tag: str, rounds: int = 4) -> tuple[str, str]:
    _, e2 = ellipsoid
    a = ellipsoid[0]
    lon = s.add(f"lon{tag}", f"atan2({y}, {x})")
    s.add(f"p{tag}", f"sqrt({x} * {x} + {y} * {y})")
    lat = s.add(f"lat{tag}0", f"atan2({z}, p{tag} * (1 - {e2!r}))")
    for i in range(1, rounds + 1):  # converges by a factor of some hundred a round
        lat = s.add(f"lat{tag}{i}", f"atan2({z} + {e2!r} * {a!r} / sqrt(1 - {e2!r} * pow(sin({lat}), 2)) * sin({lat}), p{tag})")
    return lon, lat


def _shifted(s: Steps, sign: int) -> None:
    for axis, metres in zip("xyz", SHIFT):
        s.add(f"{axis}t", f"{axis}s + {sign * metres!r}")


def to_lv95_steps() -> Steps:
    """From columns lon, lat (degrees) to east, north (metres)."""
    s = Steps()
    s.add("lam", "radians(lon)")
    s.add("phi", "radians(lat)")
    _to_geocentric(s, "lam", "phi", WGS84, "s")
    _shifted(s, -1)
    lam, phi = _from_geocentric(s, "xt", "yt", "zt", BESSEL, "b")
    s.add("iso", f"{_ALPHA!r} * (ln(tan({math.pi / 4!r} + {phi} / 2)) - {_E / 2!r} * ln((1 + {_E!r} * sin({phi})) / (1 - {_E!r} * sin({phi})))) + {_K!r}")
    s.add("ball", f"2 * (atan(exp(iso)) - {math.pi / 4!r})")
    s.add("turn", f"{_ALPHA!r} * ({lam} - {LAMBDA0!r})")
    s.add("l2", f"atan2(sin(turn), {math.sin(_B0)!r} * tan(ball) + {math.cos(_B0)!r} * cos(turn))")
    s.add("b2", f"asin({math.cos(_B0)!r} * sin(ball) - {math.sin(_B0)!r} * cos(ball) * cos(turn))")
    s.add("east", f"{_RADIUS!r} * l2 + {FALSE_EAST!r}")
    s.add("north", f"{_RADIUS / 2!r} * ln((1 + sin(b2)) / (1 - sin(b2))) + {FALSE_NORTH!r}")
    return s


def to_wgs84_steps(rounds: int = 6) -> Steps:
    """From columns east, north (metres) to lon, lat (degrees)."""
    s = Steps()
    s.add("l2", f"(east - {FALSE_EAST!r}) / {_RADIUS!r}")
    s.add("b2", f"2 * (atan(exp((north - {FALSE_NORTH!r}) / {_RADIUS!r})) - {math.pi / 4!r})")
    s.add("ball", f"asin({math.cos(_B0)!r} * sin(b2) + {math.sin(_B0)!r} * cos(b2) * cos(l2))")
    s.add("turn", f"atan2(sin(l2), {math.cos(_B0)!r} * cos(l2) - {math.sin(_B0)!r} * tan(b2))")
    s.add("lam", f"{LAMBDA0!r} + turn / {_ALPHA!r}")
    s.add("iso", f"(ln(tan({math.pi / 4!r} + ball / 2)) - {_K!r}) / {_ALPHA!r}")
    phi = s.add("phi0", "ball")
    for i in range(1, rounds + 1):
        phi = s.add(f"phi{i}", f"2 * atan(exp(iso + {_E!r} * ln(tan({math.pi / 4!r} + asin({_E!r} * sin({phi})) / 2)))) - {math.pi / 2!r}")
    _to_geocentric(s, "lam", phi, BESSEL, "s")
    _shifted(s, 1)
    lon, lat = _from_geocentric(s, "xt", "yt", "zt", WGS84, "w")
    s.add("lon", f"degrees({lon})")
    s.add("lat", f"degrees({lat})")
    return s


STEPS = {("EPSG:4326", "EPSG:2056"): to_lv95_steps, ("EPSG:2056", "EPSG:4326"): to_wgs84_steps}
AXES = {"EPSG:2056": ("east", "north"), "EPSG:4326": ("lon", "lat")}


def as_sql(steps: Steps, source: str, wanted: str) -> str:
    """A query: the steps one subquery after another over `source`, then the wanted columns."""
    for name, expression in steps.steps:
        source = f"SELECT *, {expression} AS {name} FROM ({source})"
    return f"SELECT {wanted} FROM ({source})"


def transformed(df: DataFrame, x: Column, y: Column, source: str, target: str, out: tuple[str, str]) -> DataFrame:
    """df with the point (x, y) of one reference system in another, as the columns `out`."""
    if source == target:
        return df.withColumns({out[0]: x, out[1]: y})
    if (source, target) not in STEPS:
        raise ValueError(f"no way from {source!r} to {target!r}; there are {sorted(STEPS)}")
    given, got = AXES[source], AXES[target]
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), x.cast("double").alias(given[0]), y.cast("double").alias(given[1]))
    for name, expression in STEPS[source, target]().steps:
        held = held.withColumn(name, F.expr(expression))
    return held.select(*(F.col(f"__row.`{c}`") for c in df.columns if c not in out), F.col(got[0]).alias(out[0]), F.col(got[1]).alias(out[1]))
