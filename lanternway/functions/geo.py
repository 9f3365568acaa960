"""Geohash, distance and travel-weight expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres, the geohash alphabet, the bound on speed in m/s of the search heuristic.
EARTH_RADIUS_M = 6_371_008.8
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
HEURISTIC_MPS = 33.34


def canonical(coordinate: Column) -> Column:
    """The float32 value of a coordinate, as a double; null where it is not finite."""
    f = coordinate.cast("float").cast("double")
    return F.when(~F.isnan(f) & (F.abs(f) < float("inf")), f)


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2), F.lit(2.0)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2), F.lit(2.0)
    )
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS_M)


def travel_weight(metres: Column, kph: Column) -> Column:
    """Whole centiseconds to travel ``metres``, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(metres / (kph / 3.6) * 100)).cast("long")


def heuristic_weight(metres: Column, scale: float = 100.0) -> Column:
    """The least weight any edge over that distance may have."""
    return F.floor(metres / HEURISTIC_MPS * scale).cast("long")


def geohash_encode(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Geohash of 1 to 12 characters; a point on a midpoint belongs to the lower half.

    Closed form: the index of a value among 2^b half-open-from-below intervals is ceil(x) - 1, kept
    within range; the characters pick its bits. Null for null coordinates.
    """
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2

    def index(value: Column, low: float, span: float, bits: int) -> Column:
        steps = float(1 << bits)
        raw = F.ceil((value - low) * (steps / span)) - 1
        return F.greatest(F.lit(0).cast("long"), F.least(raw, F.lit((1 << bits) - 1).cast("long")))

    def spell(code: Column) -> Column:
        """Characters of the interleaved bits, longitude first; code is bound once by the lambda below."""
        chars = []
        for c in range(precision):
            value = F.lit(0).cast("long")
            for b in range(5):
                place = 5 * c + b
                of, bits = (code["x"], lon_bits) if place % 2 == 0 else (code["y"], lat_bits)
                value = value + F.shiftright(of, bits - 1 - place // 2).bitwiseAND(F.lit(1).cast("long")) * (1 << (4 - b))
            chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
        return F.concat(*chars)

    codes = F.array(F.struct(index(lon, -180.0, 360.0, lon_bits).alias("x"), index(lat, -90.0, 180.0, lat_bits).alias("y")))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.element_at(F.transform(codes, spell), 1))


def geohash_box(cell: Column) -> Column:
    """Struct (south, west, north, east) of a geohash's cell; null for an empty or invalid one."""
    h = F.lower(F.trim(F.regexp_replace(cell, r"^[\s ​]+|[\s ​]+$", "")))
    start = F.struct(F.lit(-90.0).alias("s"), F.lit(-180.0).alias("w"), F.lit(180.0).alias("dy"), F.lit(360.0).alias("dx"), F.lit(0).alias("n"))

    # One fold over the characters; even ones give 3 bits to longitude and 2 to latitude, odd ones the reverse.
    def fold(acc: Column, ch: Column) -> Column:
        v = F.position(ch, F.lit(GEOHASH_ALPHABET)) - 1
        b = [F.shiftright(v, 4 - k).bitwiseAND(F.lit(1)) for k in range(5)]
        even = acc["n"] % 2 == 0
        three, two = b[0] * 4 + b[2] * 2 + b[4], b[1] * 2 + b[3]
        ix, iy = F.when(even, three).otherwise(two), F.when(even, two).otherwise(three)
        nx, ny = F.when(even, F.lit(8.0)).otherwise(F.lit(4.0)), F.when(even, F.lit(4.0)).otherwise(F.lit(8.0))
        dx, dy = acc["dx"] / nx, acc["dy"] / ny
        return F.struct((acc["s"] + dy * iy).alias("s"), (acc["w"] + dx * ix).alias("w"), dy.alias("dy"), dx.alias("dx"), (acc["n"] + 1).alias("n"))

    box = F.aggregate(F.filter(F.split(h, ""), lambda c: c != ""), start, fold)
    valid = h.rlike(f"^[{GEOHASH_ALPHABET}]+$")
    made = F.struct(box["s"].alias("south"), box["w"].alias("west"), (box["s"] + box["dy"]).alias("north"), (box["w"] + box["dx"]).alias("east"), box["dy"].alias("dy"), box["dx"].alias("dx"))
    return F.when(valid, made)


def geohash_centre(cell: Column) -> Column:
    """Struct (lat, lon) of the centre of a geohash's cell; null for an empty or invalid one."""
    box = geohash_box(cell)
    return F.when(box.isNotNull(), F.struct((box["south"] + box["dy"] / 2).alias("lat"), (box["west"] + box["dx"] / 2).alias("lon")))
