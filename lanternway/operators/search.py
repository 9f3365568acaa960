"""Least-cost search over a directed multigraph: many sources at once, and point to point.

Three ways with equal results, as all costs are whole numbers. The relational one relaxes a frontier with joins and
aggregations and runs at any size. The kernel one is for small graphs: edges travel once through the driver as packed
arrays and a heap search runs per request, requests spread over tasks. Between them, a graph of any size is taken apart into
its weakly connected components, which go to tasks with their requests; only a component that no task can hold is relaxed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.operators.components import connected_components
from lanternway.runtime import SALTS, Scratch, salted_join

#: Edges up to which the whole graph goes through the driver to every task: some 150 bytes each there while they are packed.
DRIVER_EDGES = 500_000
#: Edges of one component up to which a task searches it: about 24 bytes each in a Python worker, a few times that while they are packed.
KERNEL_EDGES = 4_000_000
#: Edges of the components that share a task, about; edges times requests, and requests, from which a component is searched in several.
GROUP_EDGES, GROUP_WORK, GROUP_ASKED = 200_000, 20_000_000, 100_000
#: A cost function may raise a weight to at most so many times.
MOST_FACTOR = 20


def costed(edges: DataFrame, edge_cost: Column | None = None) -> DataFrame:
    """Cheapest edge of each (source, target) with its cost: a, b, w.

    Edges without an end or with a weight under 1 are left out. edge_cost: an expression over source, target
    and weight. A cost that
    is null, not whole or outside [weight, MOST_FACTOR x weight] is an error when it is reached.
    """
    base = edges.where("source is not null and target is not null and weight >= 1")
    if edge_cost is None:
        w = F.col("weight").cast("long")
    else:
        c = edge_cost
        ok = c.isNotNull() & (c == F.floor(c)) & (c >= F.col("weight")) & (c <= F.col("weight") * MOST_FACTOR)
        w = F.when(ok, c.cast("long")).otherwise(F.raise_error(F.concat(F.lit("edge cost out of range at "), F.col("source").cast("string"))).cast("long"))
    return base.select(F.col("source").alias("a"), F.col("target").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))


def relax(links: DataFrame, seeds: DataFrame, budget_rounds: int = 10_000) -> DataFrame:
    """Least cost from any seed of a key to each node it reaches along links: key, node_id, cost.

    links: a, b, w. seeds: key, node_id, cost. Each round extends only what improved in the last one; improved
    labels are reduced by key and node before they travel.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "search")
    links = scratch.keep(links)
    best = scratch.keep(seeds.where("node_id is not null").groupBy("key", "node_id").agg(F.min("cost").alias("cost")))
    frontier = best
    for _ in range(budget_rounds):
        # Both sides may hold a node many times (hub, many keys); AQE splits what is skewed, the sum is combined early.
        step = links.join(frontier.select(F.col("node_id").alias("a"), "key", "cost"), "a")
        reached = step.groupBy("key", F.col("b").alias("node_id")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        better = reached.join(best, ["key", "node_id"], "left").where("cost is null or new < cost").select("key", "node_id", F.col("new").alias("cost"))
        fresh = scratch.keep(better)
        if fresh.isEmpty():
            return best
        merged = scratch.keep(best.unionByName(fresh).groupBy("key", "node_id").agg(F.min("cost").alias("cost")))
        scratch.drop(best)
        if frontier is not best:
            scratch.drop(frontier)
        best, frontier = merged, fresh
    raise RuntimeError("search exceeded its rounds")


#: Links up to which one task may search from all exits at once.
ONE_TASK_EDGES = 1_000_000


def _costs_to(along: DataFrame, seeds: DataFrame, kernel: bool | None) -> DataFrame:
    """relax for one set of seeds; in one task if the links are at most ONE_TASK_EDGES."""
    if kernel is False or along.count() > ONE_TASK_EDGES:
        return relax(along, seeds).select("node_id", "cost")
    both = along.select("a", "b", "w").unionByName(seeds.select(F.col("node_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("w")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"a": [], "b": [], "w": []}), *batches])
        start = pdf["b"].isna()
        seeds_ = pdf.loc[start, "a"].to_numpy(np.int64)
        graph = PackedGraph(*(pdf.loc[~start, c].to_numpy(np.int64) for c in "abw"))
        ids, cost = graph.distances(seeds_)
        alone = np.setdiff1d(seeds_, graph.ids)
        yield pd.DataFrame({"node_id": np.r_[ids, alone], "cost": np.r_[cost, np.zeros(len(alone), np.int64)]})

    return both.coalesce(1).mapInPandas(run, "node_id long, cost long")


def nearest_exit(edges: DataFrame, exits: DataFrame, edge_cost: Column | None = None, towards: bool = True, kernel: bool | None = None) -> DataFrame:
    """For each node that reaches an exit, the cost to the nearest and the next node on the way: node_id, cost, next.

    exits: node_id; null and repeated ones make no difference, and an exit without edges is its own
    exit. With towards=False costs run from the exits. An exit's next is itself; of equally good next
    nodes the smallest is given.
    """
    links = Scratch(edges.sparkSession, "links").keep(costed(edges, edge_cost))
    along = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w") if towards else links
    seeds = exits.where("node_id is not null").select(F.lit(0).alias("key"), "node_id", F.lit(0).cast("long").alias("cost")).distinct()
    cost = Scratch(edges.sparkSession, "cost").keep(_costs_to(along, seeds, kernel))
    steps = along.join(cost.select(F.col("node_id").alias("a"), F.col("cost").alias("ca")), "a").join(cost.select(F.col("node_id").alias("b"), F.col("cost").alias("cb")), "b")
    nxt = steps.where("ca + w = cb").groupBy(F.col("b").alias("node_id")).agg(F.min("a").alias("step"))
    return cost.join(nxt, "node_id", "left").select("node_id", "cost", F.when(F.col("cost") == 0, F.col("node_id")).otherwise(F.col("step")).alias("next"))


class PackedGraph:
    """Adjacency as arrays: for node number i the links offset[i]..offset[i + 1]."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.ids = np.unique(np.concatenate([a, b]))
        s, t = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        order = np.lexsort((t, s))
        self.target, self.weight = t[order], w[order]
        self.offset = np.searchsorted(s[order], np.arange(len(self.ids) + 1))

    def number(self, node: int) -> int:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def distances(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node ids, costs) of all nodes reached from any of the seed ids."""
        dist = np.full(len(self.ids), -1, np.int64)
        heap = [(0, k) for k in sorted({self.number(int(x)) for x in seeds} - {-1})]
        best = dict((k, 0) for _, k in heap)
        target, weight, offset = self.target.tolist(), self.weight.tolist(), self.offset.tolist()
        while heap:
            d, u = heapq.heappop(heap)
            if dist[u] >= 0:
                continue
            dist[u] = d
            for k in range(offset[u], offset[u + 1]):
                v, nd = target[k], d + weight[k]
                if nd < best.get(v, nd + 1):
                    best[v] = nd
                    heapq.heappush(heap, (nd, v))
        hit = dist >= 0
        return self.ids[hit], dist[hit]

    def settled(self, source: int, target: int) -> int:
        """How many nodes a search from source settles until it settles target, or all it reaches."""
        s, t = self.number(source), self.number(target)
        if s < 0 or s == t:
            return 0
        far, closed, heap = {s: 0}, set(), [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in closed:
                continue
            closed.add(u)
            if u == t:
                break
            span = slice(self.offset[u], self.offset[u + 1])
            for v, w in zip(self.target[span].tolist(), self.weight[span].tolist()):
                if d + w < far.get(v, d + w + 1):
                    far[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        return len(closed)

    def path(self, source: int, target: int) -> tuple[int | None, list[int]]:
        """(cost, nodes) of a cheapest path; (None, []) if there is none. Of equally cheap predecessors the smallest is taken."""
        if source == target:
            return 0, [source]
        s, t = self.number(source), self.number(target)
        if s < 0 or t < 0:
            return None, []
        dist, came, settled = {s: 0}, {}, set()
        heap = [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in settled:
                continue
            if u == t:
                nodes = [t]
                while nodes[-1] != s:
                    nodes.append(came[nodes[-1]])
                return d, [int(self.ids[i]) for i in reversed(nodes)]
            settled.add(u)
            for k in range(self.offset[u], self.offset[u + 1]):
                v, nd = int(self.target[k]), d + int(self.weight[k])
                if nd < dist.get(v, nd + 1):
                    dist[v] = nd
                    came[v] = u
                    heapq.heappush(heap, (nd, v))
                elif v in came and nd == dist[v] and u < came[v]:  # numbers are in the order of ids
                    came[v] = u
        return None, []


def packed(links: DataFrame) -> PackedGraph | None:
    """The links as arrays if they are at most DRIVER_EDGES, else None."""
    if links.count() > DRIVER_EDGES:
        return None
    pdf = links.select("a", "b", "w").toPandas()
    return PackedGraph(*(pdf[c].to_numpy(np.int64) for c in "abw"))


def by_component(rows: DataFrame, asked: DataFrame, parts: DataFrame, find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame | None]:
    """``find(rows of some whole components, requests inside them)`` in tasks, for every request; nothing of the graph reaches the driver.

    rows: the graph, its column a being a node. asked: request_id, source, target. parts: node_id, root of every node with links. A
    request whose ends are null, unknown or in different components is put to ``find`` without rows. Second is None,
    or the requests, with their root, inside components of more than KERNEL_EDGES rows, which are left to the caller.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "parts")
    parts = scratch.keep(parts.select("node_id", "root"))
    at = lambda end: parts.select(F.col("node_id").alias(end), F.col("root").alias(f"{end}_root"))
    ends = asked.join(at("source"), "source", "left").join(at("target"), "target", "left")
    asked = scratch.keep(ends.select("request_id", "source", "target", F.when(F.col("source_root") == F.col("target_root"), F.col("source_root")).alias("root")))
    wanted = scratch.keep(asked.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("n_asked")))
    inside = scratch.keep(rows.join(salted_join(parts, wanted.select("root"), "root", F.col("node_id")).withColumnRenamed("node_id", "a"), "a"))
    sizes = inside.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows")).join(wanted, "root")
    work = F.least(F.ceil(F.col("n_rows") * F.col("n_asked") / GROUP_WORK), F.lit(SALTS))
    times = F.greatest(F.least(work, F.col("n_asked")), F.ceil(F.col("n_asked") / GROUP_ASKED))
    sizes = scratch.keep(sizes.select("root", (F.col("n_rows") > KERNEL_EDGES).alias("large"), "n_rows", times.cast("long").alias("times")))
    sums = sizes.where("not large").agg(F.sum(F.col("n_rows") * F.col("times")), F.max("times")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums[0] or 0) // GROUP_EDGES), sums[1] or 1)
    # A component's copies stand in groups side by side, so that none has two of them.
    group = F.pmod(F.pmod(F.xxhash64("root"), F.lit(n)) + F.col("time"), F.lit(n)).alias("group")
    few = sizes.where("not large").select("root", "times")
    left = salted_join(inside, few, "root", F.col("a")).withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).select(group, *rows.columns)
    right = salted_join(asked.where("root is not null"), few, "root", F.col("request_id")).withColumn("time", F.pmod(F.xxhash64("request_id"), F.col("times"))).select(group, "request_id", "source", "target")
    found = left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(lambda g, r: find(g.drop(columns="group"), r.drop(columns="group")), schema)
    none = pd.DataFrame({c: [] for c in rows.columns})
    apart = asked.where("root is null").select("request_id", "source", "target").mapInPandas(lambda batches: (find(none, r) for r in batches), schema)
    large = sizes.where("large").select("root")
    return found.unionByName(apart), None if large.isEmpty() else salted_join(asked.where("root is not null"), large, "root", F.col("request_id"))


def _paths(graph: PackedGraph, asked: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r, s, t in asked.itertuples(index=False):
        cost, path = (None, []) if pd.isna(s) or pd.isna(t) else graph.path(int(s), int(t))
        rows.append((r, s, t, "no-route" if cost is None else "complete", cost, path))
    out = pd.DataFrame(rows, columns=["request_id", "source", "target", "status", "cost", "path"])
    return out.astype({"source": "Int64", "target": "Int64", "cost": "Int64"})


def shortest_paths(edges: DataFrame, requests: DataFrame, edge_cost: Column | None = None, kernel: bool | None = None) -> DataFrame:
    """Cheapest path of each request: request_id, source, target, status, cost, path ARRAY<BIGINT>.

    requests: request_id, source, target. status is 'complete', or 'no-route' (cost null, path empty) if an end is
    null or unknown or no path leads there. From a node to itself costs 0, known or not. Of
    equally cheap paths the one is given that takes the smallest predecessor, seen from the target. kernel: None chooses by the number of edges.
    """
    spark = edges.sparkSession
    links = Scratch(spark, "links").keep(costed(edges, edge_cost))
    asked = requests.select("request_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct()
    schema = "request_id long, source long, target long, status string, cost long, path array<bigint>"
    if kernel is False:
        return _relational_paths(links, asked)
    if (graph := packed(links)) is not None:
        shared = spark.sparkContext.broadcast(graph)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _paths(shared.value, pdf)

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return asked.repartition(n, "request_id").mapInPandas(run, schema)
    parts = connected_components(links.select(F.col("a").alias("source"), F.col("b").alias("target")))
    find = lambda rows, r: _paths(PackedGraph(*(rows[c].to_numpy(np.int64) for c in "abw")), r)
    found, large = by_component(links, asked, parts, find, schema)
    return found if large is None else found.unionByName(relaxed(links, parts, large))


def relaxed(links: DataFrame, parts: DataFrame, large: DataFrame) -> DataFrame:
    """shortest_paths by relaxation for requests inside some components only. large: request_id, source, target, root."""
    nodes = salted_join(parts, large.select("root").distinct(), "root", F.col("node_id"))
    return _relational_paths(links.join(nodes.select(F.col("node_id").alias("a")), "a", "left_semi"), large.select("request_id", "source", "target"))


def _relational_paths(links: DataFrame, asked: DataFrame) -> DataFrame:
    """shortest_paths by relaxation, for graphs of any size; paths are walked back from the targets."""
    spark = links.sparkSession
    scratch = Scratch(spark, "paths")
    seeds = asked.select(F.col("source").alias("key"), F.col("source").alias("node_id"), F.lit(0).cast("long").alias("cost"))
    cost = scratch.keep(relax(links, seeds))
    reached = cost.select(F.col("key").alias("source"), F.col("node_id").alias("target"), "cost")
    found = scratch.keep(asked.join(reached, ["source", "target"]))
    back = links.join(cost.select("key", F.col("node_id").alias("a"), F.col("cost").alias("ca")), "a").join(cost.select("key", F.col("node_id").alias("b"), F.col("cost").alias("cb")), ["key", "b"])
    came = scratch.keep(back.where("ca + w = cb").groupBy("key", F.col("b").alias("at")).agg(F.min("a").alias("previous")))
    walk = scratch.keep(found.select("request_id", F.col("source").alias("key"), F.col("target").alias("at"), F.array("target").alias("path")))
    done = walk.where("at = key")
    while True:
        walk = scratch.keep(walk.where("at <> key").join(came, ["key", "at"]).select("request_id", "key", F.col("previous").alias("at"), F.concat(F.array("previous"), "path").alias("path")))
        if walk.isEmpty():
            break
        done = done.unionByName(walk.where("at = key"))
    whole = asked.join(found.select("request_id", "cost"), "request_id", "left").join(done.select("request_id", "path"), "request_id", "left")
    same = F.col("source") == F.col("target")
    c = F.when(same, F.lit(0)).otherwise(F.col("cost"))
    return whole.select(
        "request_id", "source", "target", F.when(c.isNull(), "no-route").otherwise("complete").alias("status"), c.cast("long").alias("cost"),
        F.when(same, F.array("source")).otherwise(F.coalesce("path", F.expr("cast(array() as array<bigint>)"))).alias("path"),
    )


def path_sums(paths: DataFrame, edges: DataFrame, edge_cost: Column | None = None) -> DataFrame:
    """The cost of each complete path added up edge by edge, the cheapest of parallel ones: request_id, steps, total."""
    each = paths.where("status = 'complete'").select("request_id", F.posexplode("path").alias("k", "b"), "path")
    steps = each.where("k > 0").select("request_id", F.element_at("path", F.col("k")).alias("a"), "b")
    sums = steps.join(costed(edges, edge_cost), ["a", "b"], "left").groupBy("request_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("w").alias("total"))
    return paths.where("status = 'complete'").select("request_id").join(sums, "request_id", "left").select("request_id", F.coalesce("steps", F.lit(0).cast("long")).alias("steps"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))
