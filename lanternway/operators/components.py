"""Weakly connected components and dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.runtime import Scratch, salted_join


def global_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with the place of each row, from 0, in the order of the given columns; a total order is expected.

    Range-sorted, written, and numbered by partition offsets: no single task sees all rows, and only a
    row count a partition reaches the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = Scratch(spark, "index").keep(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, total = [], 0
    for row in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((row["p"], total))
        total += row["count"]
    starts = spark.createDataFrame(offsets, "_p long, _start long")  # a row a partition
    return placed.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + at).drop("_m", "_p", "_start")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node_id, root: the smallest id of the node's weakly connected component.

    Alternates two steps over the links alone until nothing moves: every node hangs its larger
    neighbours on the least id it knows, then its smaller ones. edges: source, target; null ends are
    dropped. nodes: node_id of further nodes, each its own component if it has no edge.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.where("source is not null and target is not null")
    ids = pairs.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    if nodes is not None:
        ids = ids.unionByName(nodes.where("node_id is not null").select("node_id")).distinct()
    links = scratch.keep(pairs.where("source <> target").select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b")).distinct())
    before, n = None, links.count()
    while True:
        # larger neighbours to the least of the whole neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = salted_join(both.where("b > a"), least, "a", F.col("b"), rows=n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = scratch.keep(big.where("a <> b").distinct())
        # smaller neighbours to the least of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(big, low, "a", F.col("b"), rows=n)
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = scratch.keep(moved.where("a <> b").distinct())
        scratch.drop(big)
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(links)
        links, n = after, sign[0]
        if sign == before:
            break
        before = sign
    return ids.join(links.select(F.col("a").alias("node_id"), F.col("b").alias("r")), "node_id", "left").select("node_id", F.coalesce("r", "node_id").alias("root"))


def ranked_components(members: DataFrame) -> DataFrame:
    """node_id, component: 0 is the largest; equal sizes by who was seen first.

    members: node_id, root, first_seen (any orderable value, unique a node).
    """
    members = Scratch(members.sparkSession, "members").keep(members)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("first_seen").alias("seen"))
    ranked = global_index(sizes, [F.col("size").desc(), F.col("seen")], "component").select("root", "component", "size")
    return salted_join(members, ranked, "root", F.col("node_id"), rows=members.count()).select("node_id", "component", "size")
