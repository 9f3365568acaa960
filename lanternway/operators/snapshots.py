"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternway.runtime import Scratch

#: Patterns tried where the plain ISO cast finds no instant; fixed values.
TIME_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyyMMdd'T'HHmmssX", "yyyyMMdd'T'HHmmss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss")


def instant(text: Column) -> Column:
    """The instant an ISO text names, whatever its style; null if it names none."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("timestamp"), *[F.try_to_timestamp(t, F.lit(p)) for p in TIME_PATTERNS])


def canonical_tags(tags: Column) -> Column:
    """Tag maps as sorted entries; null and empty are one."""
    return F.coalesce(F.array_sort(F.map_entries(tags)), F.expr("cast(array() as array<struct<key:string,value:string>>)"))


def snapshot_order(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """Usable snapshots with their place in their region: region_id, dataset_id, seq from 1, last.

    Usable: a manifest names the dataset with a readable instant, and none of its delivered rows has
    a remark (a blank one is none). Equal instants go by dataset_id; of several instants for one
    dataset the latest counts. The result has a row a snapshot, however many elements that holds.
    """
    delivered = (
        snapshots.where("dataset_id is not null")
        .groupBy("dataset_id")
        .agg(
            F.min("region_id").alias("region_id"),
            F.max((F.coalesce(F.trim("remark"), F.lit("")) != "").cast("int")).alias("remarked"),
        )
        .where("remarked = 0")
    )
    dated = (
        manifests.select(F.col("datasetId").alias("dataset_id"), instant(F.col("source.timestamp")).alias("at"))
        .where("dataset_id is not null and at is not null")
        .groupBy("dataset_id")
        .agg(F.max("at").alias("at"))
    )
    w = W.partitionBy("region_id").orderBy("at", "dataset_id")
    return (
        delivered.join(dated, "dataset_id")
        .select("region_id", "dataset_id", F.row_number().over(w).alias("seq"), F.lead("dataset_id").over(w).alias("next_dataset"))
    )


def snapshot_changes(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """Elements added, removed or changed from each usable snapshot of a region to the next.

    A full outer join on (snapshot, type, id) of each snapshot's row hashes with its predecessor's:
    a missing side is an addition or a removal, unequal hashes a change. The hash covers lat and lon
    rounded to 7 decimals, the node list and the sorted tags; null and empty tags are equal.
    Elements without type or id have no identity and are skipped; an element delivered twice counts
    once, its latest delivery deciding. A snapshot without elements removes all. The first gives
    nothing. Result: distinct (region_id, dataset_id, element_type, element_id, change).
    """
    order = Scratch(snapshots.sparkSession, "order").keep(snapshot_order(snapshots, manifests))  # a row a snapshot, used three times
    e = F.col("e")
    hashes = (
        # Rows of snapshots that are not compared go before their elements are unfolded and hashed.
        snapshots.join(order.select("dataset_id"), "dataset_id", "left_semi").select("dataset_id", "delivered_at", F.explode("elements").alias("e"))
        .where("e.type is not null and e.id is not null")
        .select(
            "dataset_id", "delivered_at", e["type"].alias("element_type"), e["id"].alias("element_id"),
            F.xxhash64(
                # +0.0 makes one of the two zeroes; nulls get flags, as the hash itself passes over them
                F.round(e["lat"], 7) + 0.0, F.round(e["lon"], 7) + 0.0, e["lat"].isNull(), e["lon"].isNull(),
                F.coalesce(F.to_json(e["nodes"]), F.lit("-")), F.to_json(canonical_tags(e["tags"])),
            ).alias("h"),
        )
        .groupBy("dataset_id", "element_type", "element_id")
        .agg(F.max(F.struct("delivered_at", "h"))["h"].alias("h"))
    )
    now = hashes.join(order.where("seq > 1").select("dataset_id", "region_id"), "dataset_id")
    before = (
        hashes.join(order.where("next_dataset is not null").select("dataset_id", "next_dataset", "region_id"), "dataset_id")
        .select(F.col("next_dataset").alias("dataset_id"), "region_id", "element_type", "element_id", F.col("h").alias("h0"))
    )
    keys = ["region_id", "dataset_id", "element_type", "element_id"]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = now.alias("a").join(before.alias("b"), same[0] & same[1] & same[2] & same[3], "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("h") != F.col("h0"), "changed")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], change.alias("change")).where("change is not null")


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per region, snapshot, element type and kind."""
    return changes.groupBy("region_id", "dataset_id", "element_type", "change").agg(F.count(F.lit(1)).alias("n_elements"))
