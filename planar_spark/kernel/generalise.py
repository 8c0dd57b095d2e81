"""Simplifying, densifying, smoothing and projecting coordinate arrays."""

from __future__ import annotations

import math

import numpy as np

from .wkb import Geometry

RADIUS = 6378137.0  # fixed value: metres, of the web-Mercator sphere


def simplify(a: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker, with a stack instead of recursion."""
    keep = np.zeros(len(a), bool)
    keep[[0, -1]] = True
    todo = [(0, len(a) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, q, m = a[i], a[j], a[i + 1 : j]
        d = q - p
        size = math.hypot(*d)
        away = np.abs(d[0] * (m[:, 1] - p[1]) - d[1] * (m[:, 0] - p[0])) / size if size else np.hypot(*(m - p).T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return a[keep]


def segmentize(a: np.ndarray, longest: float) -> np.ndarray:
    """Equal parts no longer than ``longest``."""
    out = [a[:1]]
    for p, q in zip(a, a[1:], strict=False):
        n = max(1, math.ceil(math.hypot(*(q - p)) / longest))
        out.append(p + (q - p) * (np.arange(1, n + 1) / n)[:, None])
    return np.concatenate(out)


def chaikin(a: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Corner cutting; the ends of an open line stay, a closed one stays closed."""
    for _ in range(rounds):
        closed = len(a) > 2 and (a[0] == a[-1]).all()
        cut = np.stack([0.75 * a[:-1] + 0.25 * a[1:], 0.25 * a[:-1] + 0.75 * a[1:]], axis=1).reshape(-1, 2)
        a = np.concatenate([cut, cut[:1]]) if closed else np.concatenate([a[:1], cut[1:-1], a[-1:]])
    return a


# The WGS 84 ellipsoid, and what UTM adds: scale on the middle meridian, false easting, false northing of the south.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0
# Coefficients of Krüger's series by powers of the third flattening n, from n^j on: forward, inverse, and from conformal to geographic latitude.
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))
THIRD = FLATTENING / (2 - FLATTENING)
MEAN = MAJOR / (1 + THIRD) * (1 + THIRD**2 / 4 + THIRD**4 / 64)  # radius of the circle as long as a meridian


def series(coefficients: tuple) -> list[float]:
    return [sum(c * THIRD ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(coefficients, 1)]


def utm_zone(srid: int) -> tuple[float, bool] | None:
    """Middle meridian in degrees and whether it is southern, of 326zz and 327zz; None of others."""
    zone = srid % 100
    return (zone * 6.0 - 183, srid // 100 == 327) if srid // 100 in (326, 327) and 1 <= zone <= 60 else None


def to_utm(a: np.ndarray, meridian: float, south: bool) -> np.ndarray:
    """Transverse Mercator by Krüger's series to the fourth power, within a micrometre over a zone; longitude and latitude in degrees."""
    lon, lat = np.radians(a[:, 0] - meridian), np.radians(a[:, 1])
    e = 2 * math.sqrt(THIRD) / (1 + THIRD)
    t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    u, v = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
    terms = list(enumerate(series(FORWARD), 1))
    north = u + sum(c * np.sin(2 * j * u) * np.cosh(2 * j * v) for j, c in terms)
    east = v + sum(c * np.cos(2 * j * u) * np.sinh(2 * j * v) for j, c in terms)
    return np.stack([EAST + SCALE * MEAN * east, SCALE * MEAN * north + (SOUTH if south else 0)], axis=1)


def from_utm(a: np.ndarray, meridian: float, south: bool) -> np.ndarray:
    north, east = (a[:, 1] - (SOUTH if south else 0)) / (SCALE * MEAN), (a[:, 0] - EAST) / (SCALE * MEAN)
    terms = list(enumerate(series(INVERSE), 1))
    u = north - sum(c * np.sin(2 * j * north) * np.cosh(2 * j * east) for j, c in terms)
    v = east - sum(c * np.cos(2 * j * north) * np.sinh(2 * j * east) for j, c in terms)
    conformal = np.arcsin(np.sin(u) / np.cosh(v))
    lat = conformal + sum(c * np.sin(2 * j * conformal) for j, c in enumerate(series(LATITUDE), 1))
    return np.stack([meridian + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(lat)], axis=1)


def project(a: np.ndarray, source: int, target: int) -> np.ndarray:
    """Between longitude and latitude (4326), web Mercator (3857) and the zones of UTM (326zz north, 327zz south); others raise ValueError."""
    if source == target:
        return a
    if (source, target) == (4326, 3857):
        return np.stack([np.radians(a[:, 0]) * RADIUS, RADIUS * np.log(np.tan(math.pi / 4 + np.radians(a[:, 1]) / 2))], axis=1)
    if (source, target) == (3857, 4326):
        return np.stack([np.degrees(a[:, 0] / RADIUS), np.degrees(2 * np.arctan(np.exp(a[:, 1] / RADIUS)) - math.pi / 2)], axis=1)
    if source == 4326 and (zone := utm_zone(target)):
        return to_utm(a, *zone)
    if zone := utm_zone(source):
        return project(from_utm(a, *zone), 4326, target)
    if source == 3857 and utm_zone(target):
        return project(project(a, 3857, 4326), 4326, target)
    raise ValueError(f"no projection from {source} to {target}")


def mapped(geometry: Geometry, f) -> Geometry:
    kind, parts = geometry
    return kind, [[f(r) for r in p] for p in parts] if kind == "MULTIPOLYGON" else [f(a) for a in parts]
