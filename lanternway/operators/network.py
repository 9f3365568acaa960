"""From ways and nodes to a directed weighted graph, and its simplification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.functions.geo import canonical, haversine_m, travel_weight
from lanternway.functions.rules import blocked_node, profile_rules
from lanternway.operators.nearby import regions_of_points
from lanternway.runtime import Scratch


def placed_refs(ways: DataFrame, nodes: DataFrame, profile: str) -> DataFrame:
    """One row a node reference of each way of the profile, with the node's float32 position.

    ways: way_id, nodes ARRAY<BIGINT>, tags. nodes: id unique, lat, lon, tags. A reference without a
    node, with an unusable position, or (walking) to a blocked node has a null position and cuts the
    way there. Ways with fewer than two references or no allowed direction are no part of the graph.
    """
    permitted, kph, direction = profile_rules(profile, F.col("tags"))
    used = ways.where(permitted & (F.size("nodes") >= 2)).select("way_id", "nodes", kph.alias("kph"), direction.alias("d")).where("d.forward or d.backward")
    lat, lon = canonical(F.col("lat")), canonical(F.col("lon"))
    open_ = ~blocked_node(F.col("tags")) if profile == "walking" else F.lit(True)
    there = nodes.where(open_).select(F.col("id").alias("ref"), lat.alias("lat"), lon.alias("lon")).where("lat is not null and lon is not null")
    refs = used.select("way_id", "kph", "d.forward", "d.backward", F.posexplode("nodes").alias("pos", "ref"))
    return refs.join(there, "ref", "left")


def segments(refs: DataFrame) -> DataFrame:
    """Directed edges between neighbouring references, each weighted by itself.

    Result: edge_id, way_id, pos, source, target, weight, metres and both positions; edge_id is the struct of the
    way's id and of a step, the place in the way and the direction. A cut or a repeated neighbour gives no edge.
    """
    w = W.partitionBy("way_id").orderBy("pos")
    here = refs.withColumn("p", F.lag(F.struct("ref", "lat", "lon")).over(w))
    pairs = here.where("lat is not null and p.lat is not null and p.ref <> ref")
    metres = haversine_m(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))
    flat = pairs.select("way_id", "pos", "kph", "forward", "backward", F.col("p.ref").alias("a"), F.col("ref").alias("b"), metres.alias("metres"),
                        F.struct("p.lat", "p.lon").alias("pa"), F.struct("lat", "lon").alias("pb"))
    flat = flat.withColumn("weight", travel_weight(F.col("metres"), F.col("kph")))
    way = lambda s, t, ps, pt, d: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.col(ps).alias("at_source"), F.col(pt).alias("at_target"), F.lit(d).alias("dir"))
    both = F.filter(F.array(F.when(F.col("forward"), way("a", "b", "pa", "pb", 0)), F.when(F.col("backward"), way("b", "a", "pb", "pa", 1))), lambda x: x.isNotNull())
    out = flat.withColumn("e", F.explode(both))
    edge_id = F.struct("way_id", (F.col("pos") * 2 + F.col("e.dir")).alias("step"))
    return out.select(edge_id.alias("edge_id"), "way_id", "pos", "e.source", "e.target", "weight", "metres", "e.at_source", "e.at_target")


def occurrences(refs: DataFrame) -> DataFrame:
    """How often each placed node occurs in ways: node_id, way_count, first (way, place) seen, position."""
    return refs.where("lat is not null").groupBy(F.col("ref").alias("node_id")).agg(
        F.count(F.lit(1)).alias("way_count"), F.min(F.struct("way_id", "pos")).alias("first_seen"), F.first("lat").alias("lat"), F.first("lon").alias("lon")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of directed edges at each node: node_id, degree."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def simplify_walking(refs: DataFrame) -> DataFrame:
    """Chains between kept nodes as one edge, by windows within each way.

    A node that occurs more than once is kept, so every chain lies in one way, and runs between kept
    nodes are islands. Result: source, target, weight, metres, shape ARRAY<STRUCT<lat, lon>>, way_id.
    """
    w = W.partitionBy("way_id").orderBy("pos")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    counts = occurrences(refs).select(F.col("node_id").alias("ref"), "way_count")
    pieces = refs.withColumn("fragment", F.sum(F.when(F.col("lat").isNull(), 1).otherwise(0)).over(upto)).where("lat is not null")
    f = W.partitionBy("way_id", "fragment").orderBy("pos")
    near = pieces.join(counts, "ref").withColumn("before", F.lag("ref").over(f)).withColumn("after", F.lead(F.struct("ref", "lat", "lon")).over(f))
    keep = (F.col("way_count") > 1) | F.col("before").isNull() | F.col("after").isNull() | (F.col("before") == F.col("after.ref"))
    marked = near.withColumn("island", F.sum(F.when(keep, 1).otherwise(0)).over(f.rowsBetween(W.unboundedPreceding, 0))).withColumn("keep", keep)
    steps = marked.where("after is not null and after.ref <> ref")
    metres = haversine_m(F.col("lat"), F.col("lon"), F.col("after.lat"), F.col("after.lon"))
    steps = steps.withColumn("metres", metres).withColumn("weight", travel_weight(metres, F.col("kph")))
    interior = F.when(~F.col("keep"), F.struct("pos", F.struct("lat", "lon").alias("at")))
    chains = steps.groupBy("way_id", "fragment", "island").agg(
        F.min_by("ref", "pos").alias("a"), F.max_by("after.ref", "pos").alias("b"), F.sum("weight").alias("weight"), F.sum("metres").alias("metres"),
        F.array_sort(F.collect_list(interior)).alias("s"), F.first("forward").alias("forward"), F.first("backward").alias("backward"),
    ).withColumn("shape", F.transform("s", lambda x: x["at"]))
    ahead = chains.where("forward").select(F.col("a").alias("source"), F.col("b").alias("target"), "weight", "metres", "shape", "way_id")
    back = chains.where("backward").select(F.col("b").alias("source"), F.col("a").alias("target"), "weight", "metres", F.reverse("shape").alias("shape"), "way_id")
    return ahead.unionByName(back)


def kept_nodes(edges: DataFrame) -> DataFrame:
    """node_id, keep: whether a node offers a choice and so survives simplification."""
    ends = edges.select(F.col("source").alias("node_id"), F.col("target").alias("other"), F.lit(1).alias("out")).unionByName(
        edges.select(F.col("target").alias("node_id"), F.col("source").alias("other"), F.lit(0).alias("out"))
    )
    # Only whether there are one, two or more edges and neighbours matters, so hubs need no sets:
    # least and greatest neighbour tell up to two apart.
    is_out = F.col("out") == 1
    o, i = F.when(is_out, F.col("other")), F.when(~is_out, F.col("other"))
    g = ends.groupBy("node_id").agg(
        F.count(o).alias("n_out"), F.count(i).alias("n_in"), F.min(o).alias("o1"), F.max(o).alias("o2"), F.min(i).alias("i1"), F.max(i).alias("i2")
    )
    one_way = (F.col("n_out") == 1) & (F.col("n_in") == 1)
    two_way = (F.col("n_out") == 2) & (F.col("n_in") == 2) & (F.col("o1") == F.col("i1")) & (F.col("o2") == F.col("i2"))
    keep = F.when((F.col("n_out") == 0) | (F.col("n_in") == 0), True).when(one_way, F.col("o1") == F.col("i1")).when(two_way, F.col("o1") == F.col("o2")).otherwise(True)
    return g.select("node_id", keep.alias("keep"))


def simplify_motor(edges: DataFrame) -> DataFrame:
    """Chains across ways as one edge, by pointer doubling; isolated rings come out unchanged.

    edges: edge_id (of any type), source, target, weight, metres, at_target. Each edge into a node that is not kept has
    one successor, so edges form disjoint lists and rings; every edge finds the head of its list in
    log2(longest) rounds, and lists are then aggregated. Result: source, target, weight, metres, shape.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "simplify")
    e = scratch.keep(edges.select("edge_id", "source", "target", "weight", "metres", "at_target"))
    through = scratch.keep(kept_nodes(e).where("not keep").select("node_id"))
    a = e.join(through.withColumnRenamed("node_id", "target"), "target", "left_semi").select("edge_id", F.col("source").alias("u"), F.col("target").alias("v"))
    b = e.join(through.withColumnRenamed("node_id", "source"), "source", "left_semi").select(F.col("edge_id").alias("next_id"), F.col("source").alias("v"), F.col("target").alias("t"))
    follows = a.join(b, "v").where("t <> u").select("next_id", "edge_id")
    # Each edge points at its predecessor; a head at itself, with distance 0.
    state = scratch.keep(e.join(follows.select(F.col("next_id").alias("edge_id"), F.col("edge_id").alias("prev")), "edge_id", "left").select(
        "edge_id", F.coalesce("prev", "edge_id").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("rank"), F.col("prev").isNull().alias("done")
    ))
    finished = -1
    while True:
        up = state.select(F.col("edge_id").alias("head"), F.col("head").alias("h2"), F.col("rank").alias("r2"), F.col("done").alias("d2"))
        nxt = scratch.keep(state.join(up, "head").select("edge_id", F.col("h2").alias("head"), (F.col("rank") + F.when(F.col("done"), 0).otherwise(F.col("r2"))).alias("rank"), (F.col("done") | F.col("d2")).alias("done")))
        scratch.drop(state)
        state = nxt
        now = state.where("done").count()
        if now == finished:  # each round a list that is not finished ends some of its edges; only rings are left
            break
        finished = now
    whole = e.join(state, "edge_id")
    lists = whole.where("done").groupBy("head").agg(
        F.min_by("source", "rank").alias("source"), F.max_by("target", "rank").alias("target"), F.sum("weight").alias("weight"), F.sum("metres").alias("metres"),
        F.array_sort(F.collect_list(F.struct("rank", "at_target"))).alias("s"),
    )
    inner = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: x["at_target"])
    rings = whole.where("not done").select("source", "target", "weight", "metres", F.expr("cast(array() as array<struct<lat:double,lon:double>>)").alias("shape"))
    return lists.select("source", "target", "weight", "metres", inner.alias("shape")).unionByName(rings)


def graph_counts(ways: DataFrame, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ways seen and used, nodes and edges."""
    seen = ways.agg(F.count(F.lit(1)).alias("ways_seen"))
    used = refs.agg(F.count_distinct("way_id").alias("ways_used"), F.count_distinct(F.when(F.col("lat").isNotNull(), F.col("ref"))).alias("nodes"))
    made = edges.agg(F.count(F.lit(1)).alias("edges"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(seen).join(one(used), "k").join(one(made), "k").drop("k")


def crop(ways: DataFrame, nodes: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region_no, way_id) of the motor ways that touch each valid region, borders included, and (region_no, id) of all placed nodes they refer to.

    regions: region_no, bounds.
    """
    permitted, _, _ = profile_rules("motor", F.col("tags"))
    places = nodes.select(F.col("id").alias("point_id"), "lat", "lon", F.lit(None).cast("string").alias("geohash"))
    inside = regions_of_points(places, regions).withColumnRenamed("point_id", "ref")
    refs = ways.where(permitted & (F.size("nodes") >= 2)).select("way_id", F.explode("nodes").alias("ref"))
    touching = refs.join(inside, "ref").select("region_no", "way_id").distinct()
    needed = ways.select("way_id", F.explode("nodes").alias("id")).join(touching, "way_id").select("region_no", "id").distinct()
    return touching, needed.join(nodes, "id", "left_semi").select("region_no", "id")
