"""Routes between two nodes by bidirectional A*, and escape to the nearest exit, over any graph that can be asked.

A graph answers four questions: ``position(node)``, ``component(node)`` (-1 if unknown), ``arcs(node, backwards)`` as pairs of
node and weight, and ``owner_missing(node)``, the cell to load before the node's arcs are known. ``sources.tileset.TileSet`` is
one, ``NodeLinks`` another; ``Within`` restricts any of them to a box.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternway.functions.geo import HEURISTIC_MPS
from lanternway.functions.lines import metres_between
from lanternway.operators import search
from lanternway.operators.components import connected_components
from lanternway.operators.search import MOST_FACTOR, PackedGraph
from lanternway.runtime import Scratch

Cost = Callable[[int, int, int], int]


@dataclass
class Route:
    """status: complete, missing-tiles, budget-exceeded or no-route; cost is None where no way was found."""

    status: str
    cost: int | None = None
    path: list[int] = field(default_factory=list)
    settled: int = 0
    missing: set[str] = field(default_factory=set)


@dataclass
class Escape:
    """next by node: the neighbour one step nearer to its exit; an exit is its own. status as of Route, or unknown-endpoints."""

    status: str = "complete"
    cost: dict[int, int] = field(default_factory=dict)
    next: dict[int, int] = field(default_factory=dict)
    missing: set[str] = field(default_factory=set)


def checked_cost(cost: Cost | None) -> Cost:
    """The cost of an arc in its own direction of travel; ValueError unless it is whole and from the weight to MOST_FACTOR times it."""
    if cost is None:
        return lambda a, b, w: w

    def ask(a: int, b: int, w: int) -> int:
        c = cost(a, b, w)
        if isinstance(c, bool) or not float(c).is_integer() or not w <= c <= MOST_FACTOR * w:
            raise ValueError(f"cost {c!r} of {a} -> {b} is not a whole number from {w} to {MOST_FACTOR * w}")
        return int(c)

    return ask


def checked_budget(most: int | None) -> float:
    if most is None:
        return math.inf
    if isinstance(most, bool) or most != int(most) or most < 0:
        raise ValueError("a budget is a whole number from 0 on")
    return most


def least_weight(a: tuple[float, float], b: tuple[float, float]) -> int:
    """No way between the places weighs less, in centiseconds."""
    return math.floor(metres_between(a, b) / HEURISTIC_MPS * 100)


class _Front:
    """One of the two searches. Keys are 2 x distance + lean(node), where the leans of the two searches cancel out at every node."""

    def __init__(self, start: int, backwards: bool, lean: Callable[[int], int]):
        self.backwards, self.lean = backwards, lean
        self.far, self.via, self.closed = {start: 0}, {start: start}, set()
        self.queue = [(lean(start), start)]

    def top(self) -> int | None:
        while self.queue and self.queue[0][1] in self.closed:
            heapq.heappop(self.queue)
        return self.queue[0][0] if self.queue else None

    def reach(self, node: int, far: int, via: int) -> None:
        if far < self.far.get(node, far + 1):
            self.far[node], self.via[node] = far, via
            heapq.heappush(self.queue, (2 * far + self.lean(node), node))

    def trail(self, node: int) -> list[int]:
        """From the node back to where this search began."""
        out = [node]
        while self.via[out[-1]] != out[-1]:
            out.append(self.via[out[-1]])
        return out


def route(graph, source: int, target: int, cost: Cost | None = None, most_settled: int | None = None) -> Route:
    """The cheapest way from source to target.

    Both searches lean by the same potential with opposite signs, doubled to stay whole: what the way on to the target weighs
    at least, less what the way here from the source does. A way is complete where an arc joins what the two have reached,
    and the best one known is the best there is once the two least keys add up to twice its cost. Nodes whose arcs are not
    loaded are dead ends and name their cells; unknown ends and ends in different components have no route.
    """
    budget, weigh = checked_budget(most_settled), checked_cost(cost)
    at_source, at_target = graph.position(source), graph.position(target)
    if at_source is None or at_target is None:
        return Route("no-route")
    if source == target:
        return Route("complete", 0, [source])
    one, other = graph.component(source), graph.component(target)
    if min(one, other) >= 0 and one != other:
        return Route("no-route")
    leans: dict[int, int] = {}

    def lean(node: int) -> int:
        if node not in leans:
            at = graph.position(node)
            leans[node] = 0 if at is None else least_weight(at, at_target) - least_weight(at_source, at)
        return leans[node]

    fronts = (_Front(source, False, lean), _Front(target, True, lambda n: -lean(n)))
    out = Route("complete", missing={c for n in (source, target) if (c := graph.owner_missing(n))})
    best, join = math.inf, None
    while (tops := [f.top() for f in fronts]) and None not in tops and sum(tops) < 2 * best:
        if out.settled >= budget:
            out.status = "budget-exceeded"
            break
        here, there = fronts if tops[0] <= tops[1] else fronts[::-1]
        _, node = heapq.heappop(here.queue)
        here.closed.add(node)
        out.settled += 1
        for far_end, weight in graph.arcs(node, here.backwards):
            if cell := graph.owner_missing(far_end):
                out.missing.add(cell)
            ends = (far_end, node) if here.backwards else (node, far_end)
            far = here.far[node] + weigh(*ends, weight)
            if far_end not in here.closed:
                here.reach(far_end, far, node)
            if far_end in there.far and far + there.far[far_end] < best:
                best, join = far + there.far[far_end], ends
    if join is not None:
        out.cost = int(best)
        out.path = fronts[0].trail(join[0])[::-1] + fronts[1].trail(join[1])
    if out.status == "complete":
        out.status = "missing-tiles" if out.missing else "complete" if join is not None else "no-route"
    return out


def escape(graph, exits: Iterable[int], backwards: bool = True, cost: Cost | None = None, most_settled: int | None = None) -> Escape:
    """For every node its cost to the nearest exit (or, not backwards, from it) and the next node on the way, by one search from all exits."""
    budget, weigh = checked_budget(most_settled), checked_cost(cost)
    out, unknown, queue, far, via = Escape(), True, [], {}, {}
    exits = list(exits)
    for e in exits:
        if graph.position(e) is not None:
            far[e], via[e] = 0, e
            queue.append((0, e))
    unknown = not exits or len(set(exits)) > len(far)
    out.missing |= {c for e in far if (c := graph.owner_missing(e))}
    heapq.heapify(queue)
    while queue:
        d, node = heapq.heappop(queue)
        if node in out.cost:
            continue
        if len(out.cost) >= budget:
            out.status = "budget-exceeded"
            return out
        out.cost[node], out.next[node] = d, via[node]
        for end, weight in graph.arcs(node, backwards):
            if cell := graph.owner_missing(end):
                out.missing.add(cell)
            longer = d + weigh(*((end, node) if backwards else (node, end)), weight)
            if longer < far.get(end, longer + 1):
                far[end], via[end] = longer, node
                heapq.heappush(queue, (longer, end))
    out.status = "unknown-endpoints" if unknown else "missing-tiles" if out.missing else "complete"
    return out


class NodeLinks:
    """A whole graph as arrays: links a, b, w and nodes with position and, where known, component. All of it is loaded."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, node: np.ndarray, lat: np.ndarray, lon: np.ndarray, component: np.ndarray | None = None):
        self.ahead, self.back = PackedGraph(a, b, w), PackedGraph(b, a, w)
        order = np.argsort(node)
        self.node, self.lat, self.lon = node[order], lat[order], lon[order]
        self.part = component[order] if component is not None else None

    def _at(self, node: int) -> int:
        k = int(np.searchsorted(self.node, node))
        return k if k < len(self.node) and self.node[k] == node else -1

    def position(self, node: int) -> tuple[float, float] | None:
        k = self._at(node)
        return (float(self.lat[k]), float(self.lon[k])) if k >= 0 else None

    def component(self, node: int) -> int:
        k = self._at(node)
        return int(self.part[k]) if k >= 0 and self.part is not None else -1

    def owner_missing(self, node: int) -> str | None:
        return None

    def arcs(self, node: int, backwards: bool) -> Iterator[tuple[int, int]]:
        g = self.back if backwards else self.ahead
        k = g.number(node)
        if k >= 0:
            span = slice(g.offset[k], g.offset[k + 1])
            yield from zip(g.ids[g.target[span]].tolist(), g.weight[span].tolist())


class Within:
    """A graph with only the nodes inside a box (west, south, east, north), borders included."""

    def __init__(self, graph, box: tuple[float, float, float, float]):
        self.graph, self.box = graph, box

    def position(self, node: int) -> tuple[float, float] | None:
        at = self.graph.position(node)
        w, s, e, n = self.box
        return at if at is not None and w <= at[1] <= e and s <= at[0] <= n else None

    def component(self, node: int) -> int:
        return -1  # what hangs together outside need not inside

    def owner_missing(self, node: int) -> str | None:
        return self.graph.owner_missing(node) if self.position(node) is not None else None

    def arcs(self, node: int, backwards: bool) -> Iterator[tuple[int, int]]:
        if self.position(node) is not None:
            yield from ((end, w) for end, w in self.graph.arcs(node, backwards) if self.position(end) is not None)


def _arrays(links: pd.DataFrame, nodes: pd.DataFrame) -> NodeLinks:
    return NodeLinks(*(links[c].to_numpy(np.int64) for c in "abw"), nodes["node_id"].to_numpy(np.int64), nodes["lat"].to_numpy(float), nodes["lon"].to_numpy(float), nodes["component"].fillna(-1).to_numpy(np.int64))


def _routed(graph: NodeLinks, asked: pd.DataFrame, most_settled: int | None) -> pd.DataFrame:
    rows = []
    for r, s, t in asked.itertuples(index=False):
        known = not (pd.isna(s) or pd.isna(t))
        got = route(graph, int(s), int(t), most_settled=most_settled) if known else Route("no-route")
        rows.append((r, s, t, got.status, got.cost, got.path, got.settled, graph.ahead.settled(int(s), int(t)) if got.path else 0))
    out = pd.DataFrame(rows, columns=["request_id", "source", "target", "status", "cost", "path", "settled", "settled_plain"])
    return out.astype({"source": "Int64", "target": "Int64", "cost": "Int64"})


def routes(links: DataFrame, nodes: DataFrame, requests: DataFrame, most_settled: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """``route`` for each request, spread over tasks: request_id, source, target, status, cost, path, settled, settled_plain.

    links: a, b, w with weights no less than ``least_weight`` of their ends, else costs may not be the least. nodes: node_id, lat, lon,
    component. settled_plain is what a one-sided search without potentials settles. Null or unknown ends have no route. parts:
    node_id, root of the weakly connected components of links, where they are known. Links that are more than the driver
    should hold go to the tasks by component; inside one of more than KERNEL_EDGES rows search.relax finds the ways, settled is null, and a budget is an error.
    """
    spark = links.sparkSession
    checked_budget(most_settled)
    links = links.select("a", "b", "w")
    ends = links.selectExpr("explode(array(a, b)) as node_id").distinct()
    placed = nodes.join(ends, "node_id", "left_semi").select("node_id", "lat", "lon", "component")
    asked = requests.select("request_id", "source", "target").distinct()
    schema = "request_id long, source long, target long, status string, cost long, path array<bigint>, settled long, settled_plain long"
    if links.count() <= search.DRIVER_EDGES:
        shared = spark.sparkContext.broadcast(_arrays(links.toPandas(), placed.toPandas()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _routed(shared.value, pdf, most_settled)

        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return asked.repartition(n_parts, "request_id").mapInPandas(run, schema)
    if parts is None:
        parts = connected_components(links.select(F.col("a").alias("source"), F.col("b").alias("target")))
    rows = links.selectExpr("true as link", "a", "b", "w", "0D as lat", "0D as lon", "0L as component")
    rows = rows.unionByName(placed.selectExpr("false as link", "node_id as a", "0L as b", "0L as w", "cast(lat as double) as lat", "cast(lon as double) as lon", "coalesce(cast(component as long), -1) as component"))

    def find(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        link = rows["link"].to_numpy(bool)
        return _routed(_arrays(rows[link], rows[~link].rename(columns={"a": "node_id"})), asked, most_settled)

    found, large = search.by_component(rows, asked, parts, find, schema)
    if large is None:
        return found
    if most_settled is not None:
        raise ValueError(f"a budget holds for components of at most {search.KERNEL_EDGES} rows only")
    for end in ("source", "target"):
        large = large.join(nodes.select(F.col("node_id").alias(end), F.coalesce("component", F.lit(-1)).alias(f"{end}_part")), end, "left")
    # As route has it: an end without a place, or ends in different components, have no route.
    large = Scratch(spark, "large").keep(large.withColumn("open", F.expr("source_part is not null and target_part is not null and (source_part = target_part or source_part < 0 or target_part < 0)")))
    ways = search.relaxed(links, parts, large.where("open")).select("request_id", "source", "target", "status", "cost", "path")
    shut = large.where("not open").selectExpr("request_id", "source", "target", "'no-route' as status", "cast(null as long) as cost", "cast(array() as array<bigint>) as path")
    return found.unionByName(ways.unionByName(shut).selectExpr("*", "cast(null as long) as settled", "cast(null as long) as settled_plain"))
