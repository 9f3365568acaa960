"""Search, snapping and walking routes over the project's tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternway.functions.lines import turns
from lanternway.operators import routing, search, snap
from lanternway.operators.nearby import usable_position
from lanternway.plans.network import _graph_edges, _owned
from lanternway.runtime import Scratch, table


def hazard() -> "F.Column":
    """A cost overlay for tests: weights raised up to twentyfold, by the ends' ids."""
    return F.col("weight") * (1 + F.pmod(F.col("source") * 7 + F.col("target") * 13, F.lit(20)))


def _exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every node whose id is divisible by 100 is an exit."""
    return _owned(spark, sf_dir).where("node_id % 100 = 0").select("node_id")


def nearest_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest_exit(_graph_edges(spark, sf_dir), _exits(spark, sf_dir))


def hazard_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest_exit(_graph_edges(spark, sf_dir), _exits(spark, sf_dir), hazard()).select("node_id", "cost")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge whose id is divisible by 100 asks for the way back from its target to its source."""
    return _graph_edges(spark, sf_dir).where("edge_id % 100 = 0").select(F.col("edge_id").alias("request_id"), F.col("target").alias("source"), F.col("source").alias("target"))


def shortest_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shortest_paths(_graph_edges(spark, sf_dir), _requests(spark, sf_dir)).select("request_id", "source", "target", "status", "cost")


def shortest_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose edges do not add up to their cost; there must be none, so the count is given as well."""
    edges = _graph_edges(spark, sf_dir)
    paths = Scratch(spark, "check").keep(search.shortest_paths(edges, _requests(spark, sf_dir)))
    sums = search.path_sums(paths, edges)
    return paths.where("status = 'complete'").join(sums, "request_id").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("cost") != F.col("total")).alias("n_wrong"))


def _roads(spark: SparkSession, sf_dir: str, bounds=None) -> DataFrame:
    return snap.roads_of(_graph_edges(spark, sf_dir).select("edge_id", "source", "target", "weight", "shape"), _owned(spark, sf_dir).select("node_id", "lat", "lon"), bounds)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "unresolved_nodes").where("global_id is not null").where(usable_position(F.col("lat"), F.col("lon")))
    return p.groupBy(F.col("global_id").alias("point_id")).agg(F.min(F.struct("lat", "lon")).alias("p")).select("point_id", "p.lat", "p.lon")


def snap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = Scratch(spark, "roads").keep(_roads(spark, sf_dir))
    points = _points(spark, sf_dir)
    near = Scratch(spark, "near").keep(snap.nearest_paths(points, roads))
    settled = snap.settle(points, roads, near).groupBy("point_id").agg(F.max("status").alias("settled"), F.count(F.lit(1)).alias("n_places"))
    found = snap.snap_status(points, near).join(settled, "point_id", "left")
    return found.select("point_id", F.coalesce("settled", F.lit("too-far")).alias("status"), "nearest", F.when(F.col("settled") == "ok", F.col("n_places")).otherwise(0).cast("long").alias("n_places"))


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a quarter to three quarters along every edge whose id is divisible by 100."""
    roads = Scratch(spark, "roads").keep(_roads(spark, sf_dir))
    mid = lambda p, q, f: F.struct((F.col(p)["lat"] + (F.col(q)["lat"] - F.col(p)["lat"]) * f).alias("lat"), (F.col(p)["lon"] + (F.col(q)["lon"] - F.col(p)["lon"]) * f).alias("lon"))
    ends = roads.where("edge_id % 100 = 0").select(F.col("edge_id").alias("request_id"), F.element_at("points", 1).alias("a"), F.element_at("points", 2).alias("a2"), F.element_at("points", -2).alias("z2"), F.element_at("points", -1).alias("z"))
    return snap.plan_walks(ends.select("request_id", mid("a", "a2", 0.25).alias("start"), mid("z2", "z", 0.75).alias("destination")), roads)


def plan_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = _walks(spark, sf_dir)
    return walks.select("request_id", "status", F.round("seconds", 2).alias("seconds"), F.round("metres", 2).alias("metres"), F.size("points").alias("n_points"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's route over the edges that tiles may hold, by bidirectional A*."""
    from lanternway.operators.components import connected_components
    from lanternway.plans.service import sound_edges

    scratch = Scratch(spark, "routes")
    edges = scratch.keep(sound_edges(spark, sf_dir).select("edge_id", "source", "target", "weight"))
    links = scratch.keep(search.costed(edges))
    parts = scratch.keep(connected_components(edges))
    nodes = _owned(spark, sf_dir).select("node_id", "lat", "lon").join(parts.withColumnRenamed("root", "component"), "node_id")
    return scratch.keep(routing.routes(links, nodes, _requests(spark, sf_dir), parts=parts))


def route_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("request_id", "source", "target", "status", "cost")


def route_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes settled per routable request by bidirectional A* and by a plain search, and how many routes do not add up."""
    got = _routes(spark, sf_dir).where("status = 'complete' and source <> target")
    return got.agg(F.count(F.lit(1)).alias("n_routes"), F.round(F.avg("settled"), 2).alias("settled"), F.round(F.avg("settled_plain"), 2).alias("settled_plain"))


def turn_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns along every edge's own line."""
    said = _roads(spark, sf_dir).select("edge_id", F.posexplode(turns(F.col("points"), F.col("lengths"))).alias("step", "t"))
    return said.select("edge_id", "step", F.round("t.along", 2).alias("along"), F.col("t.what").alias("instruction"))


QUERIES = {f.__name__: f for f in (nearest_exit, hazard_cost, shortest_cost, shortest_path_check, route_cost, route_effort, snap_points, plan_walk, turn_list)}
