"""Consolidating pairwise matches into groups by low-diameter decomposition.

Each level: every vertex draws an exponential shift, and clusters grow from starts that are the earlier the larger
the shift, until no vertex hears of a better one: a vertex joins the centre c that maximises shift(c) - distance(c, v).
Shifts end at REACH, which bounds the radius of clusters; the edges cut fall by a constant factor a level all the same.
Clusters become the vertices of the next level, which has only the edges between clusters. When no edge is left the
assignments are composed from the top down. Every step is a join or an aggregation with map-side combining; no
component, adjacency list or link list is ever gathered in a task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.runtime import CROWD_ROWS, Scratch, hot_keys, salted_join

#: Rate of the shifts, about the share of edges cut a level, and the most a shift may be: no cluster reaches that far, so
#: growth is complete after one round less.
RATE, REACH = 0.3, 6


def _shift(vertex: Column, level: int) -> Column:
    """An exponential variate, at most REACH, that depends on vertex and level only, so lost tasks repeat it."""
    u = F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level), F.lit("shift")), 11).cast("double") / float(1 << 53)
    return F.least(-F.log(F.lit(1.0) - u) / RATE, F.lit(float(REACH)))


def _grow(links: DataFrame, level: int, hot: list) -> DataFrame:
    """(v, c): the centre each vertex of links (a, b) joins: of those whose shift less the distance is largest the greatest id.

    A centre is heard at a distance below its shift only, so REACH - 1 rounds find the best of every vertex. A label travels
    along links only, so v and c are always connected. Every vertex also hears itself, at distance 0.
    """
    vertices = links.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    here, there = F.lit(0.0).alias("far"), F.lit(1.0).alias("far")
    heard_from = links.select("a", "b", there).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), there)).unionByName(vertices.select("a", F.col("a").alias("b"), here))
    label = heard_from.groupBy(F.col("b").alias("v")).agg(F.max(F.struct((_shift(F.col("a"), level) - F.col("far")).alias("key"), F.col("a").alias("c"))).alias("best"))
    for _ in range(REACH - 2):
        told = salted_join(heard_from, label.withColumnRenamed("v", "a"), "a", F.col("b"), hot=hot)
        label = told.groupBy(F.col("b").alias("v")).agg(F.max(F.struct((F.col("best.key") - F.col("far")).alias("key"), F.col("best.c").alias("c"))).alias("best"))
    return label.select("v", F.col("best.c").alias("c"))


def connected_groups(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row for each id that occurs in an edge with both ends given, with the smallest id of its group.

    Direction, repeated and parallel edges and further columns make no difference; an edge with a null
    end is no edge; a self-loop alone makes a group of one; an empty table gives no rows.
    Result: node_id, group_id.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "groups")
    given = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    pairs = scratch.keep(given.select(F.least(source, target).cast("long").alias("a"), F.greatest(source, target).cast("long").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    links, levels, sizes = pairs.where("a <> b"), [], []
    while n := links.count():
        # A hub's many links are salted wherever they are joined; each label stands once.
        hot = hot_keys(links.select(F.explode(F.array("a", "b")).alias("v")), "v") if n > CROWD_ROWS else []
        grown = scratch.keep(_grow(links, len(levels), hot))
        levels.append(grown)
        sizes.append(n)
        one = salted_join(links, grown.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", F.col("b"), hot=hot)
        two = salted_join(one, grown.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", F.col("a"), hot=hot)
        rest = two.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        older, links = links, scratch.keep(rest)
        if len(levels) > 1:
            scratch.drop(older)
    top = None
    for grown, n in zip(reversed(levels), reversed(sizes)):
        if top is None:
            top = grown.withColumnRenamed("c", "root")
        else:
            up = top.withColumnRenamed("v", "c")
            below, top = top, scratch.keep(salted_join(grown, up, "c", F.col("v"), "left", rows=2 * n).select("v", F.coalesce("root", "c").alias("root")))
            scratch.drop(below)
            scratch.drop(grown)
    if top is None:
        return nodes.select(F.col("v").alias("node_id"), F.col("v").alias("group_id"))
    least = top.groupBy("root").agg(F.min("v").alias("group_id"))
    grouped = salted_join(top, least, "root", F.col("v"), rows=2 * sizes[0]).select("v", "group_id")
    return nodes.join(grouped, "v", "left").select(F.col("v").alias("node_id"), F.coalesce("group_id", "v").alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """How many groups there are of each size."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_groups"))
