"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternway.llm.groups import connected_groups, group_sizes
from lanternway.llm.mixing import mix_documents
from lanternway.llm.packing import fill_report, pack_documents
from lanternway.llm.stuffing import find_stuffed
from lanternway.llm.valuemap import is_case, map_values
from lanternway.plans.general import current_ways
from lanternway.runtime import Scratch, salted_join, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.array(*[F.struct(F.lit(k).alias("tag_key"), F.col(k).alias("value")) for k in ("highway", "oneway")])).alias("t")
    ways = current_ways(spark, sf_dir).select(F.lit("osm_ways").alias("ref_table"), F.col("id").alias("record_id"), tags)
    roads = table(spark, sf_dir, "road_records").where("road_id is not null").select(F.lit("road_records").alias("ref_table"), F.col("road_id").alias("record_id"), tags)
    reference = table(spark, sf_dir, "tag_values")
    entries = reference.select("tag_key", F.col("canonical").alias("value"))
    cases = ways.unionByName(roads).select("ref_table", "record_id", "t.*").where(is_case(F.col("value"))).join(entries, ["tag_key", "value"], "left_anti")
    meant = map_values(cases.select("tag_key", "value"), reference)
    # A value that very many records share is a hot key of this join.
    both = lambda df: df.withColumn("typed", F.concat_ws("\x00", "tag_key", "value"))
    return salted_join(both(cases), both(meant).select("typed", "canonical"), "typed", F.col("record_id")).select("ref_table", "record_id", "tag_key", "canonical").distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).where("canonical = 'unmatched'").groupBy("ref_table", "tag_key").agg(F.count(F.lit(1)).alias("n_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(table(spark, sf_dir, "graph_edges"))


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(p6_found(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each container and document whether its parts are all there, once, and no bin it lies in is overfull."""
    packed = Scratch(spark, "packed").keep(p7_containers(spark, sf_dir))
    caps = table(spark, sf_dir, "container_sizes").groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    loads = packed.groupBy("container", "bin_id").agg(F.sum("part_tokens").alias("load")).join(caps, "container").where("load <= capacity").select("container", "bin_id")
    parts = packed.join(loads, ["container", "bin_id"]).groupBy("container", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part_no").alias("k"), F.max("part_no").alias("last"))
    return parts.select("container", "doc_id", ((F.col("n") == F.col("k")) & (F.col("last") == F.col("k") - 1)).alias("whole"))


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a weight: the share of a text's characters that are letters."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").withColumn("weight", F.length(F.regexp_replace(text, r"\P{L}+", "")) / F.greatest(F.length(text), F.lit(1)))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_weighed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_weighed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: its documents, and whether the mixture keeps the rule on repeats and misses the tokens wanted, or all there are, by no more than a document."""
    shares = p8_shares(spark, sf_dir)
    full = F.col("available_tokens") * F.col("max_repeats")
    near = F.abs(F.col("used_tokens") - F.least("wanted_tokens", full)) <= F.col("largest_tokens")
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    return shares.join(docs, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), near.alias("on_target"))


def p9_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_stuffed(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_measures(spark, sf_dir).where("is_stuffed").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p6_found, p6_sizes, p7_containers, p7_fill, p7_cover, p8_mixture, p8_shares, p8_check, p9_found, p9_measures)}
