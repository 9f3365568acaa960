"""The general data-quality problems as queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternway.functions.units import speed_number, to_kmh_x100, unit_in, unit_in_prose
from lanternway.operators.nearby import near_pairs, regions_of_points, usable_position
from lanternway.operators.orphans import find_orphans, orphan_counts
from lanternway.operators.snapshots import change_counts, snapshot_changes
from lanternway.operators.unitdecode import decode_units
from lanternway.runtime import Scratch, table


def current_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of highest version of each way, tags of interest as columns; the later load decides a tie."""
    w = table(spark, sf_dir, "osm_ways").where("id is not null")
    tag = lambda k: F.col("tags")[k].alias(k)
    fields = ["version", "loaded_at", "edited_at", "region_id", "highway", "oneway", "maxspeed"]
    flat = w.select("id", "version", "loaded_at", "edited_at", "region_id", tag("highway"), tag("oneway"), tag("maxspeed"))
    return flat.groupBy("id").agg(F.max(F.struct(*fields)).alias("r")).select("id", "r.*")


def current_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of highest version of each node; the later load decides a tie."""
    n = table(spark, sf_dir, "osm_nodes").where("id is not null")
    return n.groupBy("id").agg(F.max(F.struct("version", "loaded_at", "visible", "lat", "lon")).alias("r")).select("id", "r.*")


def p1_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "osm_nodes").select(F.col("id").alias("key"), "version", "visible", "loaded_at")
    ways = table(spark, sf_dir, "osm_ways").select(F.col("id").alias("record_id"), F.explode(F.array_distinct("nodes")).alias("key"), "loaded_at")
    ends = table(spark, sf_dir, "graph_edges").select(F.col("edge_id").alias("record_id"), F.explode(F.array_distinct(F.array("source", "target"))).alias("key"), "loaded_at")
    return find_orphans(nodes, [("osm_ways", ways), ("graph_edges", ends)])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_orphans(spark, sf_dir).withColumnRenamed("key", "node_id").select("ref_table", "period", "record_id", "node_id", "reason")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p1_orphans(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "osm_snapshots"), table(spark, sf_dir, "pack_manifests"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_counts(p3_found(spark, sf_dir))


def speed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated speed with what is known of its unit, as decode_units takes them."""
    none = F.lit(None).cast("string")
    ways = current_ways(spark, sf_dir).where("maxspeed is not null").select(
        F.lit("osm_ways").alias("ref_table"), F.col("id").alias("record_id"), F.concat_ws("/", F.lit("osm_ways"), "region_id").alias("device"),
        F.col("edited_at").alias("at"), "maxspeed", none.alias("remark"), F.lit("km/h").alias("said"),
    )
    feeds = table(spark, sf_dir, "feeds").groupBy("feed").agg(F.max(unit_in_prose(F.concat_ws(" ", "note"))).alias("said"))
    roads = table(spark, sf_dir, "road_records").where("maxspeed is not null").join(feeds, "feed", "left").select(
        F.lit("road_records").alias("ref_table"), F.col("road_id").alias("record_id"), F.col("feed").alias("device"),
        F.col("surveyed_at").alias("at"), "maxspeed", "remark", "said",
    )
    return ways.unionByName(roads).select(
        "ref_table", "record_id", "device", "at", speed_number(F.col("maxspeed")).alias("number"),
        unit_in(F.col("maxspeed")).alias("written"), unit_in(F.col("remark")).alias("noted"), "said",
    )


def p4_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated speed with its unit: ref_table, record_id, number, unit, kmh_x100."""
    return decode_units(speed_records(spark, sf_dir)).withColumn("kmh_x100", to_kmh_x100(F.col("number"), F.col("unit")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_speeds(spark, sf_dir).where("unit <> 'km/h'").select("ref_table", "record_id", "kmh_x100").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_speeds(spark, sf_dir).groupBy("ref_table", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("kmh_x100").alias("least"), F.max("kmh_x100").alias("most"))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the decoder does where it is told less: the notes of the feeds are withheld, and per unit of the bare figures of
    feeds it is counted how many records it still gives that unit."""
    records = Scratch(spark, "speeds").keep(speed_records(spark, sf_dir))
    feeds = F.col("ref_table") == "road_records"
    blind = decode_units(records.withColumn("said", F.when(~feeds, F.col("said"))))
    bare = records.where(feeds & F.col("written").isNull() & F.col("noted").isNull() & F.col("said").isNotNull())
    met = bare.select("ref_table", "record_id", "number", "said").distinct().join(blind, ["ref_table", "record_id", "number"])
    right = F.count_if(F.col("unit") == F.col("said"))
    return met.groupBy(F.col("said").alias("unit")).agg(F.count(F.lit(1)).alias("n_records"), right.alias("n_right"), F.round(right / F.count(F.lit(1)), 4).alias("recall"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_nodes(spark, sf_dir).where("visible").select("id", "lat", "lon")
    near = near_pairs(nodes.where(usable_position(F.col("lat"), F.col("lon"))), 4.0)
    points = table(spark, sf_dir, "unresolved_nodes").withColumnRenamed("global_id", "point_id")
    inside = regions_of_points(points, table(spark, sf_dir, "catalog_regions"))
    return near.select(F.lit("near").alias("relation"), "left_id", "right_id").unionByName(
        inside.select(F.lit("inside").alias("relation"), F.col("point_id").alias("left_id"), F.col("region_no").alias("right_id"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_report, p4_found, p4_report, p4_recall, p5_found)}
