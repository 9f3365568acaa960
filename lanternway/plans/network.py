"""The road network derived from the project's tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternway.functions.geo import canonical, geohash_box, geohash_encode
from lanternway.operators import components, network
from lanternway.operators.nearby import regions_of_points, usable_position, valid_bounds
from lanternway.runtime import Scratch, table


def base_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, nodes, tags, region_id of each way's highest version, the later load deciding a tie."""
    w = table(spark, sf_dir, "osm_ways").where("id is not null")
    rows = F.max_by(F.struct("nodes", "tags", "region_id"), F.struct("version", "loaded_at"))
    return w.groupBy(F.col("id").alias("way_id")).agg(rows.alias("r")).select("way_id", "r.*")


def base_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, tags of each node whose highest version is visible and has a usable position."""
    n = table(spark, sf_dir, "osm_nodes").where("id is not null")
    rows = F.max_by(F.struct("lat", "lon", "tags", "visible"), F.struct("version", "loaded_at"))
    return n.groupBy("id").agg(rows.alias("r")).select("id", "r.*").where(F.col("visible") & usable_position(F.col("lat"), F.col("lon"))).drop("visible")


def _refs(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    return network.placed_refs(base_ways(spark, sf_dir), base_nodes(spark, sf_dir), profile)


def _segments(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    return network.segments(_refs(spark, sf_dir, profile))


def segments_walking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "walking").select(F.concat_ws(":", "edge_id.way_id", "edge_id.step").alias("edge_id"), "way_id", "source", "target", "weight", F.round("metres", 3).alias("metres"))


def segments_motor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "motor").select(F.concat_ws(":", "edge_id.way_id", "edge_id.step").alias("edge_id"), "way_id", "source", "target", "weight", F.round("metres", 3).alias("metres"))


def node_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir, "motor")
    degree = network.degrees(network.segments(refs))
    return network.occurrences(refs).join(degree, "node_id", "left").select("node_id", "way_count", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir, "motor")
    return network.graph_counts(base_ways(spark, sf_dir), refs, network.segments(refs))


def simplify_walking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = network.simplify_walking(_refs(spark, sf_dir, "walking"))
    return s.select("way_id", "source", "target", "weight", F.round("metres", 3).alias("metres"), F.size("shape").alias("n_shape"))


def _simple_motor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.simplify_motor(_segments(spark, sf_dir, "motor"))


def simplify_motor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _simple_motor(spark, sf_dir)
    return s.select("source", "target", "weight", F.round("metres", 3).alias("metres"), F.size("shape").alias("n_shape"))


def bbox_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways and nodes of each valid catalogue region in one list."""
    ways, nodes = network.crop(base_ways(spark, sf_dir), base_nodes(spark, sf_dir), table(spark, sf_dir, "catalog_regions"))
    return ways.select("region_no", F.lit("way").alias("kind"), F.col("way_id").alias("id")).unionByName(nodes.select("region_no", F.lit("node").alias("kind"), "id"))


def _graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges with both ends given."""
    return table(spark, sf_dir, "graph_edges").where("edge_id is not null and source is not null and target is not null").dropDuplicates(["edge_id"])


def components_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components.connected_components(_graph_edges(spark, sf_dir))
    return components.ranked_components(found.withColumn("first_seen", F.col("node_id"))).select("node_id", F.col("component").cast("int").alias("component"))


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = components.connected_components(_graph_edges(spark, sf_dir)).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.sum("n").alias("n_nodes"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.global_index(base_nodes(spark, sf_dir).select(F.col("id").alias("osm_id")), ["osm_id"], "node_id")


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, float32 position and owner cell of each node."""
    lat, lon = canonical(F.col("lat")), canonical(F.col("lon"))
    return base_nodes(spark, sf_dir).select(F.col("id").alias("node_id"), lat.alias("lat"), lon.alias("lon")).withColumn("cell", geohash_encode(F.col("lat"), F.col("lon"), 6))


def placed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_edges with the owner cells of both ends; edges with an end that has no place are left out."""
    owned = _owned(spark, sf_dir).select("node_id", "cell")
    e = _graph_edges(spark, sf_dir).select("edge_id", "source", "target", "weight", "metres", "shape")
    e = e.join(owned.select(F.col("node_id").alias("source"), F.col("cell").alias("source_cell")), "source")
    return e.join(owned.select(F.col("node_id").alias("target"), F.col("cell").alias("target_cell")), "target")


def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge in the tiles of both its ends, with the adjacency it belongs to there."""
    cells = F.explode(F.array_distinct(F.array("source_cell", "target_cell"))).alias("cell")
    out = placed_edges(spark, sf_dir).select("edge_id", "source", "target", "weight", "source_cell", "target_cell", cells)
    return out.select("cell", "edge_id", "source", "target", "weight", (F.col("source_cell") == F.col("cell")).alias("forward"), (F.col("target_cell") == F.col("cell")).alias("reverse"))


def tile_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned nodes of each tile and, as halo, the far ends of edges that leave it."""
    own = _owned(spark, sf_dir).select("cell", "node_id", F.lit(False).alias("halo"))
    crossing = placed_edges(spark, sf_dir).where("source_cell <> target_cell")
    halo = crossing.select(F.col("source_cell").alias("cell"), F.col("target").alias("node_id")).unionByName(crossing.select(F.col("target_cell").alias("cell"), F.col("source").alias("node_id"))).distinct()
    return own.unionByName(halo.withColumn("halo", F.lit(True)))


def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tile_nodes(spark, sf_dir).groupBy("cell").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("halo").alias("halo_nodes"))
    e = tile_edges(spark, sf_dir).groupBy("cell").agg(F.count_if("forward").alias("forward_edges"), F.count_if("reverse").alias("reverse_edges"))
    zero = F.lit(0).cast("long")
    return n.join(e, "cell", "left").select("cell", "nodes", "halo_nodes", F.coalesce("forward_edges", zero).alias("forward_edges"), F.coalesce("reverse_edges", zero).alias("reverse_edges"))


def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the out-edges of each node of a tile begin; a tile is a cell's worth of nodes, so one window task."""
    from pyspark.sql import Window as W

    out = tile_edges(spark, sf_dir).where("forward").groupBy("cell", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    nodes = tile_nodes(spark, sf_dir).join(out, ["cell", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    w = W.partitionBy("cell").orderBy("node_id")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return nodes.select("cell", (F.row_number().over(w) - 1).alias("slot"), "node_id", before.alias("offset"), "n")


def geometry_interning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored shape per unordered pair of ends and canonical form, with the way it is read along each edge."""
    e = _graph_edges(spark, sf_dir).withColumn("stored_forward", F.col("source") <= F.col("target"))
    shape = F.coalesce("shape", F.expr("cast(array() as array<struct<lat:float,lon:float>>)"))
    e = e.withColumn("canonical", F.when(F.col("stored_forward"), shape).otherwise(F.reverse(shape)))
    key = F.sha2(F.to_json(F.struct(F.least("source", "target"), F.greatest("source", "target"), "canonical")), 256)
    e = e.select("edge_id", "stored_forward", F.size("canonical").alias("n_points"), key.alias("key"))
    first = e.groupBy("key").agg(F.min("edge_id").alias("geometry_id"))
    return e.join(first, "key").select("edge_id", "geometry_id", "n_points", (~F.col("stored_forward")).alias("reversed"))


def tile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that break a rule of the format: weight out of range, or less than the fastest travel allows."""
    from lanternway.functions.geo import haversine_m, heuristic_weight

    n = _owned(spark, sf_dir)
    at = lambda p: n.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    e = _graph_edges(spark, sf_dir).select("edge_id", "source", "target", "weight", "shape").join(at("source"), "source", "left").join(at("target"), "target", "left")
    least = heuristic_weight(haversine_m(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon")))
    bad_shape = F.exists("shape", lambda p: p["lat"].isNull() | p["lon"].isNull() | F.isnan(p["lat"]) | F.isnan(p["lon"]))
    checks = F.array(
        F.when(F.col("source_lat").isNull(), F.lit("source has no place")), F.when(F.col("target_lat").isNull(), F.lit("target has no place")),
        F.when((F.col("weight") < 1) | (F.col("weight") > 4294967295) | F.col("weight").isNull(), F.lit("weight out of range")),
        F.when(F.col("weight") < least, F.lit("weight below bound")), F.when(bad_shape, F.lit("shape not finite")),
    )
    return e.select("edge_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("violation"))


def tile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: tiles, nodes, copies in halos, edges, the mean size, and a digest of the sorted list of cells, as a build's manifest has them."""
    each = tile_stats(spark, sf_dir)
    listed = F.md5(F.concat_ws(",", F.array_sort(F.collect_list("cell"))))  # a name a tile, as the manifest lists them
    return each.agg(
        F.count(F.lit(1)).alias("tiles"), F.sum(F.col("nodes") - F.col("halo_nodes")).alias("nodes"), F.sum("halo_nodes").alias("halo_nodes"), F.sum("forward_edges").alias("edges"),
        F.round(F.avg("nodes"), 3).alias("nodes_a_tile"), listed.alias("cells_digest"),
    )


def node_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: nodes before and after simplification and the share saved in percent."""
    segs = Scratch(spark, "segments").keep(_segments(spark, sf_dir, "motor"))
    ends = lambda df, name: df.select(F.explode(F.array("source", "target")).alias("x")).agg(F.count_distinct("x").alias(name))
    both = ends(segs, "before").crossJoin(ends(network.simplify_motor(segs), "after"))  # one row each
    return both.select("before", "after", F.round(100 * (1 - F.col("after") / F.greatest(F.col("before"), F.lit(1))), 3).alias("saved_percent"))


def owner_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that tiles of different builds would both own: their visible versions lie in more than one cell."""
    lat, lon = canonical(F.col("lat")), canonical(F.col("lon"))
    n = table(spark, sf_dir, "osm_nodes").where(F.col("id").isNotNull() & F.col("visible") & usable_position(F.col("lat"), F.col("lon")))
    owned = n.select(F.col("id").alias("node_id"), geohash_encode(lat, lon, 6).alias("cell"))
    return owned.groupBy("node_id").agg(F.count_distinct("cell").alias("n_owners")).where("n_owners > 1")


def cell_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).select("node_id", "cell", geohash_encode(F.col("lat"), F.col("lon"), 4).alias("cell4"), geohash_encode(F.col("lat"), F.col("lon"), 9).alias("cell9"))


def cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _owned(spark, sf_dir).select("cell").distinct()
    b = geohash_box(F.col("cell"))
    return cells.select("cell", b.alias("b")).select("cell", "b.south", "b.west", "b.north", "b.east")


def cell_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight cells around each, in the order NW, N, NE, W, E, SW, S, SE; longitude wraps, latitude stops."""
    cells = _owned(spark, sf_dir).select("cell").distinct().withColumn("b", geohash_box(F.col("cell")))
    lat, lon = F.col("b.south") + F.col("b.dy") / 2, F.col("b.west") + F.col("b.dx") / 2
    wrap = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
    stop = lambda y: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), y))
    around = [F.struct(stop(lat + F.col("b.dy") * i).alias("lat"), wrap(lon + F.col("b.dx") * j).alias("lon")) for i, j in ((1, -1), (1, 0), (1, 1), (0, -1), (0, 1), (-1, -1), (-1, 0), (-1, 1))]
    each = cells.select("cell", F.posexplode(F.array(*around)).alias("place", "at"))
    return each.select("cell", "place", geohash_encode(F.col("at.lat"), F.col("at.lon"), 6).alias("neighbour"))


#: Fixed value: steps of cells up to which a box is covered.
MOST_STEPS = 100_000


def cells_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geohash-5 cells that cover each region of the catalogue with valid bounds; a box of more than MOST_STEPS steps is an error."""
    r = table(spark, sf_dir, "catalog_regions").where(valid_bounds(F.col("bounds"))).select("region_no", *[F.col("bounds")[i].alias(n) for i, n in enumerate("wsen")])
    step = 180.0 / 2**12  # both sides of a cell of five characters
    span = lambda lo, hi, base: F.sequence(F.greatest(F.ceil((F.col(lo) - base) / step) - 1, F.lit(0)), F.greatest(F.ceil((F.col(hi) - base) / step) - 1, F.lit(0)))
    steps = (F.ceil((F.col("n") - F.col("s")) / step) + 2) * (F.ceil((F.col("e") - F.col("w")) / step) + 2)
    r = r.withColumn("region_no", F.when(steps <= MOST_STEPS, F.col("region_no")).otherwise(F.raise_error(F.lit("box of too many cells")).cast("long")))
    grid = r.select("region_no", F.explode(span("w", "e", -180.0)).alias("x"), span("s", "n", -90.0).alias("ys")).select("region_no", "x", F.explode("ys").alias("y"))
    cell = geohash_encode(F.col("y") * step - 90 + step / 2, F.col("x") * step - 180 + step / 2, 5)
    return grid.select("region_no", cell.alias("cell")).distinct()


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each valid catalogue region the cells next needed when only the cells owned inside its western half are loaded, with the unresolved nodes in each."""
    owned = Scratch(spark, "owned").keep(_owned(spark, sf_dir))
    w, s, e, n = (F.col("bounds")[i] for i in range(4))
    halves = table(spark, sf_dir, "catalog_regions").where(valid_bounds(F.col("bounds"))).select("region_no", F.array(w, s, (w + e) / 2, n).alias("bounds"))
    inside = regions_of_points(owned.select(F.col("node_id").alias("point_id"), "lat", "lon", F.lit(None).cast("string").alias("geohash")), halves)
    loaded = Scratch(spark, "loaded").keep(inside.withColumnRenamed("point_id", "node_id").join(owned, "node_id").select("region_no", "cell").distinct())
    edges = placed_edges(spark, sf_dir)
    ahead = edges.select(F.col("source_cell").alias("cell"), F.col("target").alias("far"), F.col("target_cell").alias("far_cell"))
    back = edges.select(F.col("target_cell").alias("cell"), F.col("source").alias("far"), F.col("source_cell").alias("far_cell"))
    seen = ahead.unionByName(back).where("cell <> far_cell").join(loaded, "cell").select("region_no", "far", "far_cell").distinct()
    missing = seen.join(loaded.withColumnRenamed("cell", "far_cell"), ["region_no", "far_cell"], "left_anti")
    return missing.groupBy("region_no", F.col("far_cell").alias("cell")).agg(F.count(F.lit(1)).alias("n_unresolved"))


QUERIES = {
    f.__name__: f
    for f in (
        segments_walking, segments_motor, node_occurrence, graph_stats, simplify_walking, simplify_motor, bbox_crop, components_ranked, component_stats, dense_ids,
        tile_nodes, tile_edges, tile_stats, csr_offsets, geometry_interning, tile_quality, tile_totals, node_reduction, owner_conflicts, cell_encode, cell_bounds, cell_neighbours, cells_in_box, missing_cells,
    )
}
