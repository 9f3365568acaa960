"""Access, speed and direction of ways as expressions over a map of tags, by travel profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Free-flow speed in km/h by class, the highest speed, and the value sets of the rules.
HIGHWAY_SPEEDS = {
    "motorway": 90.0, "motorway_link": 45.0, "trunk": 70.0, "trunk_link": 40.0, "primary": 55.0, "primary_link": 35.0, "secondary": 45.0,
    "secondary_link": 30.0, "tertiary": 35.0, "tertiary_link": 25.0, "unclassified": 30.0, "residential": 25.0, "living_street": 12.0, "road": 25.0,
}
DEFAULT_KPH, MAX_KPH, MPH_KPH = 25.0, 120.0, 1.609344
BLOCKED = ("no", "private", "customers", "delivery", "agricultural", "forestry")
ALLOWED = ("yes", "designated", "permissive")
NEEDS_FOOT = ("motorway", "motorway_link", "trunk", "trunk_link")
WALKING = tuple(h for h in HIGHWAY_SPEEDS if h not in NEEDS_FOOT) + ("footway", "pedestrian", "steps", "path", "service", "track", "cycleway", "bridleway")
ONEWAY_BOTH, ONEWAY_FORWARD, ONEWAY_BACK = ("no", "false", "0"), ("yes", "true", "1"), ("-1", "reverse")
SLOW_SURFACES = ("unpaved", "gravel", "dirt", "ground", "sand", "mud", "grass")
ROUGH_SURFACES = ("cobblestone", "sett", "pebblestone", "compacted")
SOFT_SURFACES = ("sand", "mud", "ground", "gravel", "dirt")
BARRIERS = ("wall", "fence", "block")
PROFILES = ("motor", "walking")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


def tag(tags: Column, key: str) -> Column:
    """The raw value, '' if there is none."""
    return F.coalesce(tags[key], F.lit(""))


def low(tags: Column, key: str) -> Column:
    """Value without surrounding blanks, in lower case."""
    return F.lower(F.regexp_replace(tag(tags, key), r"^\s+|\s+$", ""))


def _first_decides(values: list[Column], blocked: tuple[str, ...]) -> Column:
    """True unless, going from the most special key on, a blocked value comes before an allowing one."""
    out = F.lit(True)
    for v in reversed(values):
        out = F.when(v.isin(*blocked), F.lit(False)).when(v.isin(*ALLOWED), F.lit(True)).otherwise(out)
    return out


def motor_access(tags: Column) -> Column:
    """Whether motor traffic may use a way."""
    known = tag(tags, "highway").isin(*HIGHWAY_SPEEDS)
    return known & _first_decides([low(tags, k) for k in ("motor_vehicle", "vehicle", "access")], BLOCKED)


def foot_access(tags: Column) -> Column:
    """Whether people on foot may always use a way or node; conditions that cannot be judged count as no."""
    conditional = (tag(tags, "foot:conditional") != "") | (tag(tags, "access:conditional") != "")
    timed = ~tag(tags, "opening_hours").isin("", "24/7")
    return ~conditional & ~timed & _first_decides([low(tags, k) for k in ("foot", "access")], (*BLOCKED, "destination"))


def walkable(tags: Column) -> Column:
    """Whether a way belongs to the walking network."""
    lower = lambda k: F.lower(tag(tags, k))
    fleeting = lower("temporary").isin("yes", "true", "1") | ~lower("seasonal").isin("", "no", "false", "0")
    wet = lower("bridge").isin("pontoon", "floating") | ~lower("ford").isin("", "no", "false", "0")
    h = tag(tags, "highway")
    kind = h.isin(*WALKING) | (h.isin(*NEEDS_FOOT) & low(tags, "foot").isin(*ALLOWED))
    return ~fleeting & ~wet & kind & foot_access(tags)


def blocked_node(tags: Column) -> Column:
    """Whether a node may not be walked through."""
    return ~foot_access(tags) | tag(tags, "barrier").isin(*BARRIERS)


def maxspeed_kph(raw: Column) -> Column:
    """km/h of a posted speed: a number alone or with mph, km/h or kph, or 'walk'; null for anything else."""
    wide = "".join(chr(0xFF10 + k) for k in range(10))
    v = F.translate(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), wide, "0123456789")
    parts = F.split(v, r"\s+")
    number = F.when(parts[0].rlike(_NUMBER), parts[0].try_cast("double"))
    unit = F.get(parts, F.lit(1))
    fits = (F.size(parts) <= 2) & (unit.isNull() | unit.isin("mph", "km/h", "kph"))
    value = F.when(unit == "mph", number * MPH_KPH).otherwise(number)
    usable = (number > 0) & (number < float("inf")) & fits
    return F.when(v == "walk", F.lit(5.0)).when(F.coalesce(usable, F.lit(False)), F.least(value, F.lit(MAX_KPH)))


def motor_kph(tags: Column) -> Column:
    """Speed on a way by car: as posted, else by class and surface."""
    by_class = F.create_map(*[x for k, v in HIGHWAY_SPEEDS.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(by_class[tag(tags, "highway")], F.lit(DEFAULT_KPH))
    surface = tag(tags, "surface")
    slowed = F.when(surface.isin(*SLOW_SURFACES), F.least(base, F.lit(20.0))).when(surface.isin(*ROUGH_SURFACES), F.least(base, F.lit(25.0))).otherwise(base)
    return F.coalesce(maxspeed_kph(tags["maxspeed"]), F.least(slowed, F.lit(MAX_KPH)))


def walking_kph(tags: Column) -> Column:
    return F.when(tag(tags, "highway") == "steps", 2.5).when(tag(tags, "surface").isin(*SOFT_SURFACES), 3.5).otherwise(4.8)


def motor_direction(tags: Column) -> Column:
    """Struct (forward, backward): the oneway tag, else what roundabouts and motorways imply."""
    v = low(tags, "oneway")
    implied = F.lower(tag(tags, "junction")).isin("roundabout", "circular") | (tag(tags, "highway") == "motorway")
    back_only = v.isin(*ONEWAY_BACK)
    forward_only = ~back_only & (v.isin(*ONEWAY_FORWARD) | (~v.isin(*ONEWAY_BOTH) & implied))
    return F.struct((~back_only).alias("forward"), (~forward_only).alias("backward"))


def walking_direction(tags: Column) -> Column:
    """Struct (forward, backward): only oneway:foot binds people on foot."""
    v = low(tags, "oneway:foot")
    return F.struct((~v.isin(*ONEWAY_BACK)).alias("forward"), (~v.isin(*ONEWAY_FORWARD)).alias("backward"))


def profile_rules(profile: str, tags: Column) -> tuple[Column, Column, Column]:
    """(permitted, km/h, direction) of a profile."""
    if profile == "motor":
        return motor_access(tags), motor_kph(tags), motor_direction(tags)
    if profile == "walking":
        return walkable(tags), walking_kph(tags), walking_direction(tags)
    raise ValueError(f"unknown travel profile {profile!r}")
