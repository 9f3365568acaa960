"""Labels, searches and summaries of a catalogue of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.operators.nearby import regions_of_points, valid_bounds

#: What is labelled, how many labels a region has, how long a label's text is, kilometres per degree.
PLACES = ("hospital", "clinic", "police", "fire_station")
STREETS = ("primary", "secondary", "tertiary", "pedestrian", "residential")
LABELS, MOST_LABELS, TEXT, KM_PER_DEGREE = 24, 5000, 100, 111.195


def _name(tags: Column) -> Column:
    pick = lambda k: F.when(tags[k] != "", tags[k])
    return F.coalesce(pick("name:en"), pick("name"))


def label_candidates(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """kind (0 place, 1 street), seq, name, lat, lon of everything that may be labelled; a street stands at its middle node.

    nodes: id, lat, lon, tags. ways: way_id, nodes, tags.
    """
    t = F.col("tags")
    has = lambda k: F.coalesce(t[k], F.lit("")) != ""
    place = has("place") | (F.coalesce(t["railway"], F.lit("")) == "station") | F.coalesce(t["amenity"], F.lit("")).isin(*PLACES)
    places = nodes.where(place).select(F.lit(0).alias("kind"), F.col("id").alias("seq"), _name(t).alias("name"), "lat", "lon")
    streets = ways.where((F.size("nodes") >= 2) & F.coalesce(t["highway"], F.lit("")).isin(*STREETS)).select("way_id", _name(t).alias("name"), F.element_at("nodes", (F.floor(F.size("nodes") / 2) + 1).cast("int")).alias("id")).where("name is not null")
    at = streets.join(nodes.select("id", "lat", "lon"), "id").select(F.lit(1).alias("kind"), F.col("way_id").alias("seq"), "name", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))
    return places.unionByName(at).where("name is not null")


def region_labels(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """The labels of each region: region_no, place (from 1), text, lat, lon.

    Strictly inside the bounds; the first of each full name, places before streets, each by id; at most
    min(MOST_LABELS, maxLabels), LABELS if the region says nothing. regions: region_no, bounds, maxLabels and, where only some regions show places, includePlaces.
    """
    wanted = F.col("includePlaces") if "includePlaces" in regions.columns else F.lit(True)
    keyed = candidates.withColumn("point_id", F.xxhash64("kind", "seq"))
    inside = regions_of_points(keyed.select("point_id", "lat", "lon", F.lit(None).cast("string").alias("geohash")), regions)
    b = F.col("bounds")
    r = regions.where(valid_bounds(b)).select("region_no", b[0].alias("w"), b[1].alias("s"), b[2].alias("e"), b[3].alias("n"), F.least(F.lit(MOST_LABELS), F.coalesce("maxLabels", F.lit(LABELS))).alias("cap"), F.coalesce(wanted, F.lit(False)).alias("places"))
    met = keyed.join(inside, "point_id").join(F.broadcast(r) if regions.count() <= 10_000 else r, "region_no").where("w < lon and lon < e and s < lat and lat < n and (kind > 0 or places)")
    first = met.groupBy("region_no", "name").agg(F.min(F.struct("kind", "seq", "lat", "lon")).alias("x"), F.first("cap").alias("cap"))
    w = W.partitionBy("region_no").orderBy("x.kind", "x.seq")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MOST_LABELS).where("place <= cap").select("region_no", "place", F.substring("name", 1, TEXT).alias("text"), "x.lat", "x.lon")


def search_labels(labels: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Labels whose text contains the query in any case, the first ``most`` of each region."""
    hit = labels.where(F.contains(F.lower("text"), F.lit(query.lower())))
    w = W.partitionBy("region_no").orderBy("place")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def search_regions(regions: DataFrame, query: str) -> DataFrame:
    """Regions whose name, subtitle and coverage label, joined by blanks, contain the query in any case."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "subtitle", "coverageLabel")])
    return regions.where(F.contains(F.lower(text), F.lit(query.lower())))


def first_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The first region in the catalogue's order that contains each point: point_id, region_no."""
    return regions_of_points(points, regions).groupBy("point_id").agg(F.min("region_no").alias("region_no"))


def area_km2(bounds: Column) -> Column:
    """Square kilometres of a box, by the width at its middle latitude."""
    w, s, e, n = (bounds[i] for i in range(4))
    return F.round((n - s) * KM_PER_DEGREE * ((e - w) * KM_PER_DEGREE * F.cos(F.radians((n + s) / 2))), 2)


def distance_text(metres: Column) -> Column:
    """'1.2 km' from a kilometre on, else metres to the nearest five."""
    return F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000)).otherwise(F.concat((F.floor(metres / 5 + 0.5) * 5).cast("string"), F.lit(" m")))


def bytes_text(size: Column) -> Column:
    """Megabytes of 2^20 bytes with one decimal, under one whole kilobytes rounded up."""
    return F.when(size >= 1 << 20, F.format_string("%.1f MB", size / (1 << 20))).otherwise(F.concat(F.ceil(size / 1024).cast("string"), F.lit(" KB")))


def date_text(at: Column) -> Column:
    """Day, month by name, year."""
    return F.date_format(at, "d MMM yyyy")


def minutes_left(seconds: Column, progress: Column, metres: Column) -> Column:
    """Whole minutes of a route still to go, at least one."""
    return F.greatest(F.lit(1), F.ceil(seconds * F.greatest(F.lit(0.0), 1 - progress / metres) / 60))


#: Drawing layers with the zoom from which they show and their kinds of road.
LAYERS = {
    "major": (0.0, ("trunk", "primary", "secondary", "tertiary")),
    "local": (11.5, ("residential", "unclassified", "service", "living_street", "track", "road", "motorway")),
    "walking": (13.5, ("footway", "path", "steps", "pedestrian")),
}


def road_layer(kind: Column) -> Column:
    """Struct (layer, min_zoom) of a kind of road; null for kinds that are not drawn."""
    out = F.lit(None).cast("struct<layer:string,min_zoom:double>")
    for name, (zoom, kinds) in LAYERS.items():
        out = F.when(kind.isin(*kinds), F.struct(F.lit(name).alias("layer"), F.lit(zoom).alias("min_zoom"))).otherwise(out)
    return out


def line_feature(points: Column, kind: Column) -> Column:
    """A GeoJSON feature of a line of structs lat, lon."""
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("kind")).alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry")))
