"""Catalogue, manifest, tile exchange and guidance queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.functions.geo import haversine_m, heuristic_weight
from lanternway.functions.lines import cumulative_metres, decimate
from lanternway.operators import catalog, guidance
from lanternway.operators.components import connected_components, global_index, ranked_components
from lanternway.operators.nearby import valid_bounds
from lanternway.operators.snap import bounding_box
from lanternway.plans.network import _graph_edges, _owned, base_nodes, base_ways, dense_ids, placed_edges
from lanternway.plans.routing import _roads
from lanternway.runtime import Scratch, table
from lanternway.sources.packs import manifest_violations
from lanternway.sources.tilecodec import decode_tiles, encode_tiles
from lanternway.streaming.guidance import run_to_end


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "catalog_regions")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.region_labels(catalog.label_candidates(base_nodes(spark, sf_dir), base_ways(spark, sf_dir)), _regions(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("region_no", "place", "text", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_labels(_labels(spark, sf_dir), "Street").select("region_no", "rank", "text")


def region_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_regions(_regions(spark, sf_dir), "And Surroundings").select("region_no", "id")


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "unresolved_nodes").withColumnRenamed("global_id", "point_id")
    return catalog.first_region(points, _regions(spark, sf_dir))


def region_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with its area and, where manifests name it, how many generations it has and its newest."""
    from lanternway.operators.snapshots import instant

    m = table(spark, sf_dir, "pack_manifests").select("regionId", "datasetId", instant(F.col("source.timestamp")).alias("at")).distinct()
    per = m.groupBy(F.col("regionId").alias("id")).agg(F.count_distinct("datasetId").alias("n_generations"), F.max_by("datasetId", F.struct("at", "datasetId")).alias("newest"))
    area = F.when(valid_bounds(F.col("bounds")), catalog.area_km2(F.col("bounds")))
    return _regions(spark, sf_dir).join(per, "id", "left").select("region_no", area.alias("area_km2"), F.coalesce("n_generations", F.lit(0).cast("long")).alias("n_generations"), "newest")


def manifest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per generation what its assets add up to against what it says."""
    m = table(spark, sf_dir, "pack_manifests").select("datasetId", "totalBytes", "assets").distinct()
    a = m.select("datasetId", "totalBytes", F.explode("assets").alias("a"))
    return a.groupBy(F.col("datasetId").alias("dataset_id"), F.col("totalBytes").alias("total_bytes")).agg(F.count(F.lit(1)).alias("n_assets"), F.sum("a.bytes").alias("asset_bytes"), F.count_if(F.col("a.kind") == "basemap").alias("n_basemaps"))


def saved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region the generations whose manifests break no rule, what they take together, and that in words."""
    m = table(spark, sf_dir, "pack_manifests")
    bad = manifest_verify(spark, sf_dir).select(F.col("dataset_id").alias("datasetId")).distinct()
    good = m.select("regionId", "datasetId", "totalBytes").distinct().join(bad, "datasetId", "left_anti")
    return good.groupBy(F.col("regionId").alias("region_id")).agg(F.count_distinct("datasetId").alias("n_packs"), F.sum("totalBytes").alias("saved_bytes")).withColumn("size_text", catalog.bytes_text(F.col("saved_bytes")))


def stale_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of a region that may go: all but the newest, and the date of their source in words."""
    from lanternway.operators.snapshots import instant

    m = table(spark, sf_dir, "pack_manifests").where("datasetId is not null").groupBy("regionId", "datasetId").agg(F.max(instant(F.col("source.timestamp"))).alias("at"))
    newest = m.groupBy("regionId").agg(F.max_by("datasetId", F.struct("at", "datasetId")).alias("datasetId"))
    return m.join(newest, ["regionId", "datasetId"], "left_anti").select(F.col("regionId").alias("region_id"), F.col("datasetId").alias("dataset_id"), catalog.date_text(F.col("at")).alias("date_text"))


def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_violations(table(spark, sf_dir, "pack_manifests"), _regions(spark, sf_dir))


#: Fixed value: lines of a region's preview.
FIRST = 400


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines bundled with a catalogue: of each region the first FIRST ways by id that are worth drawing small, with what is left of
    their points, their length, the minutes it takes to walk them and their box."""
    from lanternway.operators.network import placed_refs

    ways = base_ways(spark, sf_dir)
    refs = placed_refs(ways, base_nodes(spark, sf_dir), "walking").where("lat is not null")
    lines = refs.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("s"))
    points = F.transform("s", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    lines = lines.select("way_id", points.alias("points")).where("size(points) >= 2")
    few = decimate(F.col("points"))
    large = ways.where(~F.coalesce(F.col("tags")["highway"], F.lit("")).isin("steps", "service")).select("way_id", "region_id")
    w = W.partitionBy("region_id").orderBy("way_id")
    first = lines.join(large, "way_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= FIRST)
    metres, box = F.col("metres"), bounding_box(F.col("points"))
    out = first.withColumn("metres", F.element_at(cumulative_metres(F.col("points")), -1)).withColumn("b", box).where(F.size(few) >= 2)
    return out.select(
        "way_id", "region_id", F.size("points").alias("n_points"), F.size(few).alias("n_preview"), F.round("metres", 2).alias("metres"), catalog.distance_text(metres).alias("length_text"),
        catalog.minutes_left(metres / (4.8 / 3.6), F.lit(0.0), F.greatest(metres, F.lit(1e-9))).alias("minutes"), *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")],
    )


def roads_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways and points per drawing layer."""
    w = base_ways(spark, sf_dir).select(catalog.road_layer(F.col("tags")["highway"]).alias("l"), F.size("nodes").alias("n")).where("l is not null and n >= 2")
    return w.groupBy("l.layer", "l.min_zoom").agg(F.count(F.lit(1)).alias("n_roads"), F.sum("n").alias("n_points"))


def sound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed edges that a reader of tiles accepts: a weight of 32 bits, no less than the distance allows, and a finite shape."""
    own = _owned(spark, sf_dir).select("node_id", "lat", "lon")
    at = lambda p: own.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    e = placed_edges(spark, sf_dir).join(at("source"), "source").join(at("target"), "target")
    least = heuristic_weight(haversine_m(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon")))
    bad = F.coalesce(F.exists("shape", lambda p: p["lat"].isNull() | p["lon"].isNull() | F.isnan(p["lat"]) | F.isnan(p["lon"])), F.lit(False))
    return e.where((F.col("weight") >= F.greatest(least, F.lit(1))) & (F.col("weight") <= 0xFFFFFFFF) & ~bad)


def tile_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles written as binary route tiles and read back: both adjacencies with shapes and components. Nodes without edges
    are in no tile. Tiles with components beyond 16 bits are of the wide version."""
    scratch = Scratch(spark, "tiles")
    numbered = scratch.keep(dense_ids(spark, sf_dir))
    owned = _owned(spark, sf_dir).withColumnRenamed("node_id", "osm_id").join(numbered, "osm_id")
    edges = scratch.keep(sound_edges(spark, sf_dir))
    root = connected_components(edges).withColumn("first_seen", F.col("node_id"))
    ranked = ranked_components(root).select(F.col("node_id").alias("osm_id"), F.col("component").cast("int").alias("component"))
    occurs = edges.select(F.explode(F.array("source", "target")).alias("osm_id")).groupBy("osm_id").agg((F.count(F.lit(1)) > 1).alias("junction"))
    nodes = scratch.keep(owned.join(ranked, "osm_id").join(occurs, "osm_id").select("osm_id", "node_id", "lat", "lon", "cell", "component", "junction"))
    number = lambda c: nodes.select(F.col("osm_id").alias(c), F.col("node_id").alias(f"{c}_no"))
    e = edges.join(number("source"), "source").join(number("target"), "target").withColumn("cell", F.explode(F.array_distinct(F.array("source_cell", "target_cell"))))
    e = scratch.keep(e.select("cell", F.col("source_no").alias("source"), F.col("target_no").alias("target"), "weight", "shape", (F.col("source_cell") == F.col("cell")).alias("forward"), (F.col("target_cell") == F.col("cell")).alias("reverse")))
    members = nodes.select("cell", "node_id", F.lit(False).alias("halo")).unionByName(e.select("cell", F.explode(F.array("source", "target")).alias("node_id")).withColumn("halo", F.lit(True)))
    members = members.groupBy("cell", "node_id").agg(F.min("halo").alias("halo"))
    full = members.join(nodes.select("node_id", "lat", "lon", "component", "junction"), "node_id")
    tiles = scratch.keep(encode_tiles(full, e))
    return decode_tiles(tiles).withColumn("lat_sum", F.round("lat_sum", 3)).withColumn("lon_sum", F.round("lon_sum", 3))


# ---- guidance -------------------------------------------------------------------------------------------------


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fixes, routes): each user walks along the line of the edge with their place in the list of all edges of 3 m and more.

    Events are the fixes: their order gives the place along the line, their value the accuracy, and their id a delay.
    """
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    roads = global_index(_roads(spark, sf_dir).where("metres >= 3").select("edge_id", "points"), ["edge_id"], "n")
    m = max(roads.count(), 1)
    routes = Scratch(spark, "routes").keep(users.withColumn("n", F.pmod("user_id", F.lit(m).cast("long"))).join(roads, "n").select(F.col("user_id").alias("session_id"), "points"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value").withColumn("k", F.row_number().over(w))
    e = e.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("user_id"))).join(routes.withColumnRenamed("session_id", "user_id"), "user_id")
    share = F.col("k") / F.col("c")
    i = F.least(F.floor(share * (F.size("points") - 1)), F.size("points") - 2).cast("int")
    t = share * (F.size("points") - 1) - i
    p, q = F.element_at("points", i + 1), F.element_at("points", i + 2)
    wobble = (F.pmod(F.col("event_id") * 7919, F.lit(101)) - 50) * 4e-6
    fixes = e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("fix_id"), (p["lat"] + (q["lat"] - p["lat"]) * t + wobble).alias("lat"), (p["lon"] + (q["lon"] - p["lon"]) * t).alias("lon"),
        (F.abs("value") % 60).alias("accuracy"), "ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(25)) * 1_000_000).alias("processed_at"),
    )
    return fixes.withColumn("ts", F.col("ts").cast("timestamp")), routes


def fix_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events would be taken as fixes, by the rules on age and accuracy."""
    e = table(spark, sf_dir, "events")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.pmod("event_id", F.lit(31)) - 8) * 1_000_000)
    ok = guidance.admissible(F.col("value"), F.col("ts").cast("timestamp"), at)
    start = guidance.start_admissible(F.col("value"), F.col("ts").cast("timestamp"), at)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(ok).alias("n_admitted"), F.count_if(F.coalesce(start, F.lit(False))).alias("n_starts"))


def guidance_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes, routes = _sessions(spark, sf_dir)
    return guidance.guide(fixes, routes)


def guidance_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through Structured Streaming, run until all fixes are taken."""
    fixes, routes = _sessions(spark, sf_dir)
    landed = Scratch(spark, "fixes").keep(fixes)
    return run_to_end(landed._scratch_path, landed.schema, routes)


QUERIES = {
    f.__name__: f
    for f in (labels, place_search, region_search, region_lookup, region_status, manifest_assets, manifest_verify, saved_bytes, stale_generations, preview, roads_by_layer, tile_exchange, fix_admission, guidance_batch, guidance_stream)
}
