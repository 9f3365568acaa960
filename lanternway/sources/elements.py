"""Reading landed map extracts: JSON responses of elements, plain or gzipped, with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>"
RESPONSE = f"osm3s struct<timestamp_osm_base:string>, remark string, elements array<{ELEMENT}>"
REGIONS = "id string, name string, subtitle string, coverageLabel string, coverageType string, bounds array<double>, source string, includePlaces boolean, maxLabels int"


def read_responses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a response file: path, osm3s, remark, elements. Gzipped files are read as they are."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(paths).withColumn("path", F.input_file_name())


def complete_responses(responses: DataFrame) -> DataFrame:
    """The same rows; reading one with a remark or without elements is an error."""
    whole = (F.coalesce(F.col("remark"), F.lit("")) == "") & (F.coalesce(F.size("elements"), F.lit(0)) > 0)
    checked = F.when(whole, F.col("elements")).otherwise(F.raise_error(F.lit("source response is incomplete")).cast(f"array<{ELEMENT}>"))
    return responses.withColumn("elements", checked)


def split_elements(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways): id, lat, lon, tags and way_id, nodes, tags."""
    e = responses.select(F.explode("elements").alias("e")).select("e.*")
    return e.where("type = 'node'").select("id", "lat", "lon", "tags"), e.where("type = 'way'").select(F.col("id").alias("way_id"), "nodes", "tags")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region definitions: a JSON array of objects."""
    return spark.read.schema(REGIONS).option("multiLine", True).json(path)


def missing_references(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, ref of references to nodes the extract does not hold."""
    refs = ways.select("way_id", F.explode("nodes").alias("ref")).distinct()
    return refs.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").select("way_id", "ref")
