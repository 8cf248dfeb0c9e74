"""Orbital dissimilarity criteria and encounter geometry as Column expressions. Angles in degrees, q in AU.

Criteria take two orbits as dicts of Columns (q, e, i, node, peri), as :func:`orbit` makes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTS = ("q", "e", "i", "node", "peri")
EARTH_SPEED = 29.784  # km/s, mean orbital speed
PERIHELION, APHELION = 0.9833, 1.0167  # Earth's, AU
_TINY = 1e-300


def orbit(alias: str | None = None, suffix: str = "") -> dict[str, Column]:
    """The columns of an orbit in a frame, by alias or by suffix."""
    return {c: F.col(f"{alias}.{c}" if alias else f"{c}{suffix}") for c in ELEMENTS}


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _sq(x: Column) -> Column:
    return x * x


def _chord(angle: Column) -> Column:
    """(2 sin(angle / 2))^2"""
    return _sq(2.0 * F.sin(0.5 * angle))


def _rad(o: dict) -> tuple[Column, Column, Column]:
    return tuple(_angle(o, c) for c in ("i", "node", "peri"))


def _angle(o: dict, c: str) -> Column:
    return o[f"r_{c}"] if f"r_{c}" in o else F.radians(o[c])


def _sine(o: dict) -> Column:
    return o["s_i"] if "s_i" in o else F.sin(_angle(o, "i"))


def _planes(a: dict, b: dict) -> Column:
    (i1, n1), (i2, n2) = ((_angle(o, "i"), _angle(o, "node")) for o in (a, b))
    return _chord(i2 - i1) + _sine(a) * _sine(b) * _chord(n2 - n1)


def _perihelia(a: dict, b: dict, planes: Column) -> Column:
    """Squared chord of the difference of perihelion longitudes, from the line where the planes meet."""
    (i1, n1, p1), (i2, n2, p2) = _rad(a), _rad(b)
    half = F.sqrt(_clip(1.0 - 0.25 * planes, 0.0, 1.0))
    turn = F.when(F.abs(n2 - n1) > math.pi, -1.0).otherwise(1.0)
    sine = F.when(half == 0.0, F.lit(0.0)).otherwise(F.cos(0.5 * (i1 + i2)) * F.sin(0.5 * (n2 - n1)) / F.when(half != 0.0, half))
    return _chord(p2 - p1 + turn * 2.0 * F.asin(_clip(sine, -1.0, 1.0)))


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), x))


def southworth_hawkins(a: dict, b: dict) -> Column:
    planes = _planes(a, b)
    return _root(_sq(b["e"] - a["e"]) + _sq(b["q"] - a["q"]) + planes + _sq(0.5 * (a["e"] + b["e"])) * _perihelia(a, b, planes))


def jopek(a: dict, b: dict) -> Column:
    planes = _planes(a, b)
    near = _sq((b["q"] - a["q"]) / (a["q"] + b["q"] + _TINY))
    return _root(_sq(b["e"] - a["e"]) + near + planes + _sq(0.5 * (a["e"] + b["e"])) * _perihelia(a, b, planes))


def _perihelion_direction(o: dict) -> tuple[Column, Column]:
    """Ecliptic latitude and longitude of the perihelion."""
    if "lat" in o:
        return o["lat"], o["lon"]
    i, n, p = _rad(o)
    return F.asin(_clip(F.sin(i) * F.sin(p), -1.0, 1.0)), n + F.atan2(F.cos(i) * F.sin(p), F.cos(p))


def drummond(a: dict, b: dict) -> Column:
    tilt = 2.0 * F.asin(_clip(0.5 * F.sqrt(F.greatest(F.lit(0.0), _planes(a, b))), -1.0, 1.0))
    (b1, l1), (b2, l2) = _perihelion_direction(a), _perihelion_direction(b)
    theta = F.acos(_clip(F.sin(b1) * F.sin(b2) + F.cos(b1) * F.cos(b2) * F.cos(l1 - l2), -1.0, 1.0))
    shape = _sq((b["e"] - a["e"]) / (a["e"] + b["e"] + _TINY)) + _sq((b["q"] - a["q"]) / (a["q"] + b["q"] + _TINY))
    return _root(shape + _sq(tilt / math.pi) + _sq(0.5 * (a["e"] + b["e"])) * _sq(theta / math.pi))


CRITERIA = {"d_sh": southworth_hawkins, "d_d": drummond, "d_h": jopek}


def parts(o: dict, criterion: str) -> dict[str, Column]:
    """What the criterion takes of one orbit alone: a frame that has these as columns computes them once, not for every pair."""
    i, n, p = _rad(o)
    out = {"q": o["q"], "e": o["e"], "r_i": i, "r_node": n, "s_i": _sine(o)}
    return out | (dict(zip(("lat", "lon"), _perihelion_direction(o), strict=True)) if criterion == "d_d" else {"r_peri": p})


def valsecchi(a: dict, b: dict, w1: float = 1.0, w2: float = 1.0, w3: float = 1.0) -> Column:
    """Distance of geocentric invariants: dicts of u, cos_theta, phi, lam."""
    phi, lam = F.radians(b["phi"] - a["phi"]), F.radians(b["lam"] - a["lam"])
    straight = w2 * _chord(phi) + w3 * _chord(lam)
    turned = w2 * _chord(phi + math.pi) + w3 * _chord(lam + math.pi)
    return _root(_sq(b["u"] - a["u"]) + w1 * _sq(b["cos_theta"] - a["cos_theta"]) + F.least(straight, turned))


def geocentric_invariants(speed: Column, longitude: Column, latitude: Column, solar_longitude: Column) -> dict[str, Column]:
    """u, cos_theta, phi, lam of a radiant in ecliptic coordinates."""
    beta = F.radians(latitude)
    from_apex = F.radians(longitude) - (F.radians(solar_longitude) - 0.5 * math.pi)
    return {
        "u": speed / EARTH_SPEED,
        "cos_theta": -_clip(F.cos(beta) * F.cos(from_apex), -1.0, 1.0),
        "phi": F.pmod(F.degrees(F.atan2(F.sin(beta), F.cos(beta) * F.sin(from_apex))), F.lit(360.0)),
        "lam": longitude,
    }


def aphelion(q: Column, e: Column) -> Column:
    """q (1 + e) / (1 - e), infinite for e of 1 or more."""
    return F.when(e < 1.0, q * (1.0 + e) / F.greatest(1.0 - e, F.lit(1e-12))).otherwise(F.lit(float("inf")))


def crosses_earth(q: Column, e: Column) -> Column:
    return (q <= APHELION) & (aphelion(q, e) >= PERIHELION)


def is_valid(o: dict) -> Column:
    """Physical elements of an orbit that meets Earth's."""
    return crosses_earth(o["q"], o["e"]) & (o["q"] > 0) & (o["e"] >= 0) & (o["e"] < 1.2) & (o["i"] >= 0) & (o["i"] <= 180)


#: Dispersions of the elements within a stream. Fixed values.
SCALES = {"q": 0.10, "e": 0.08, "i": 6.0, "node_xy": 0.12, "peri_xy": 0.12}


def whiten(o: dict) -> dict[str, Column]:
    """Seven scaled coordinates; angles become points of a circle."""
    node, peri = F.radians(o["node"]), F.radians(o["peri"])
    return {
        "wq": o["q"] / SCALES["q"], "we": o["e"] / SCALES["e"], "wi": o["i"] / SCALES["i"],
        "wnx": F.cos(node) / SCALES["node_xy"], "wny": F.sin(node) / SCALES["node_xy"],
        "wpx": F.cos(peri) / SCALES["peri_xy"], "wpy": F.sin(peri) / SCALES["peri_xy"],
    }


def unwhiten(w: dict) -> dict[str, Column]:
    turn = lambda y, x: F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    return {
        "q": w["wq"] * SCALES["q"], "e": w["we"] * SCALES["e"], "i": _clip(w["wi"] * SCALES["i"], 0.0, 180.0),
        "node": turn(w["wny"] * SCALES["node_xy"], w["wnx"] * SCALES["node_xy"]), "peri": turn(w["wpy"] * SCALES["peri_xy"], w["wpx"] * SCALES["peri_xy"]),
    }
