"""Polylines: lengths, projection, slicing, turns; as expressions where a fold suffices, else as array code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternway.functions.geo import EARTH_RADIUS_M, haversine_m

#: Fixed values of the turn list: least angle, least distance to the last turn and to the end, angle of turning back.
TURN_DEGREES, TURN_GAP_M, END_GAP_M, BACK_DEGREES = 45.0, 25.0, 15.0, 150.0


def cumulative_metres(points: Column) -> Column:
    """Metres from the start at each of the points (structs of lat and lon)."""
    step = lambda acc, p: F.struct(
        p.alias("last"),
        F.concat(acc["out"], F.array(F.element_at(acc["out"], -1) + haversine_m(acc["last"]["lat"], acc["last"]["lon"], p["lat"], p["lon"]))).alias("out"),
    )
    start = F.struct(F.element_at(points, 1).alias("last"), F.array(F.lit(0.0)).alias("out"))
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def project(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Struct (distance, fraction, lat, lon) of the point of segment a-b nearest in the point's tangent plane."""
    cos = F.cos(F.radians(lat))
    x, y = (b["lon"] - a["lon"]) * cos, b["lat"] - a["lat"]
    square = x * x + y * y
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * cos * x + (lat - a["lat"]) * y) / square))).otherwise(0.0)
    py, px = a["lat"] + t * (b["lat"] - a["lat"]), a["lon"] + t * (b["lon"] - a["lon"])
    return F.struct(haversine_m(lat, lon, py, px).alias("distance"), t.alias("fraction"), py.alias("lat"), px.alias("lon"))


def decimate(points: Column, about: int = 10) -> Column:
    """Every n-th point so that about so many remain."""
    step = F.greatest(F.lit(1), F.floor(F.size(points) / about))
    return F.filter(points, lambda p, i: i % step == 0)


def turns(points: Column, lengths: Column) -> Column:
    """Array of structs (along, what): the start, turns worth saying, the arrival.

    Corners are found from the cross and dot product of the two steps that meet there. Of those sharp enough and not
    too near the end each is kept that lies far enough behind the one kept before.
    """
    total = F.element_at(lengths, -1)

    def corner(i: Column) -> Column:
        a, b, c = (F.element_at(points, i + k) for k in (0, 1, 2))
        shrink = F.cos(F.radians(b["lat"]))
        x0, y0, x1, y1 = (b["lon"] - a["lon"]) * shrink, b["lat"] - a["lat"], (c["lon"] - b["lon"]) * shrink, c["lat"] - b["lat"]
        return F.struct(F.element_at(lengths, i + 1).alias("along"), F.degrees(F.atan2(x1 * y0 - x0 * y1, x0 * x1 + y0 * y1)).alias("angle"))

    inner = F.when(F.size(points) > 2, F.sequence(F.lit(1), F.size(points) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    sharp = F.filter(F.transform(inner, corner), lambda c: (F.abs(c["angle"]) >= TURN_DEGREES) & (total - c["along"] > END_GAP_M))
    none = F.expr("cast(array() as array<struct<along:double,angle:double>>)")
    kept = F.aggregate(
        sharp, F.struct(F.lit(0.0).alias("last"), none.alias("kept")),
        lambda acc, c: F.when(c["along"] - acc["last"] > TURN_GAP_M, F.struct(c["along"].alias("last"), F.concat(acc["kept"], F.array(c)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    said = lambda along, what: F.struct(along.alias("along"), what.alias("what"))
    way = lambda c: F.when(F.abs(c["angle"]) > BACK_DEGREES, "back").when(c["angle"] > 0, "right").otherwise("left")
    return F.concat(F.array(said(F.lit(0.0), F.lit("start"))), F.transform(kept, lambda c: said(c["along"], way(c))), F.array(said(total, F.lit("arrive"))))


def joined(points: Column, gap: float = 0.01) -> Column:
    """The points without those at most ``gap`` metres from the one kept before."""
    empty = F.expr("cast(array() as array<struct<lat:double,lon:double>>)")

    def add(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (haversine_m(last["lat"], last["lon"], p["lat"], p["lon"]) > gap), F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, empty, add)


# ---- the same on arrays, for per-request code -----------------------------------------------------------------


def metres_between(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Between (lat, lon) pairs."""
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def lengths_of(points: list[tuple[float, float]]) -> list[float]:
    out = [0.0]
    for a, b in zip(points, points[1:]):
        out.append(out[-1] + metres_between(a, b))
    return out


def project_on(point: tuple[float, float], points: list[tuple[float, float]], lengths: list[float]) -> tuple[float, float, int, tuple[float, float]]:
    """(distance, along, segment, place) of the nearest point of a line; the first of equally near segments."""
    line = np.asarray(points)
    a, b = line[:-1], line[1:]
    cos = math.cos(math.radians(point[0]))
    x, y = (b[:, 1] - a[:, 1]) * cos, b[:, 0] - a[:, 0]
    square = x * x + y * y
    t = np.where(square > 0, ((point[1] - a[:, 1]) * cos * x + (point[0] - a[:, 0]) * y) / np.where(square > 0, square, 1), 0).clip(0, 1)
    at = a + t[:, None] * (b - a)
    d = [metres_between(point, tuple(p)) for p in at]
    k = int(np.argmin(d))
    return d[k], lengths[k] + float(t[k]) * (lengths[k + 1] - lengths[k]), k, (float(at[k][0]), float(at[k][1]))
