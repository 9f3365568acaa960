import random

import numpy as np
import pandas as pd
import pytest

from lanternway.operators import routing, search
from lanternway.sources import tilecodec
from lanternway.sources.tileset import TileSet

STEP = 0.0008


def lattice(seed, n=7, one_way=0.2):
    """Nodes (id, lat, lon) and links (a, b, w) of a lattice with weights no less than the distance allows."""
    rng = random.Random(seed)
    nodes = {i * n + j: (28.6 + i * STEP, 77.2 + j * STEP) for i in range(n) for j in range(n)}
    links = {}
    for k in nodes:
        for other in (k + 1, k + n):
            if other in nodes and (other != k + 1 or other % n):
                for a, b in ((k, other), (other, k)):
                    if rng.random() > one_way:
                        links[a, b] = routing.least_weight(nodes[a], nodes[b]) + rng.randrange(1, 900)
    return nodes, links


def as_graph(nodes, links, part=None):
    a, b, w = (np.array(x, np.int64) for x in zip(*((a, b, w) for (a, b), w in links.items())))
    ids = np.array(list(nodes), np.int64)
    lat, lon = (np.array([nodes[k][x] for k in nodes]) for x in (0, 1))
    return routing.NodeLinks(a, b, w, ids, lat, lon, None if part is None else np.array([part[k] for k in nodes]))


def tiles_of(nodes, links):
    """One tile a cell, with both adjacencies and halo."""
    cell = {k: tilecodec.cell_of(*np.array(nodes[k], np.float32).astype(float)) for k in nodes}
    out = []
    for c in sorted(set(cell.values())):
        e = [(a, b, w, [], cell[a] == c, cell[b] == c) for (a, b), w in links.items() if c in (cell[a], cell[b])]
        members = {k for k in nodes if cell[k] == c} | {x for a, b, *_ in e for x in (a, b)}
        n = pd.DataFrame([(k, *nodes[k], 0, cell[k] != c, False) for k in members], columns=["node_id", "lat", "lon", "component", "halo", "junction"])
        out.append(tilecodec.Tile(tilecodec.encode_tile(c, n, pd.DataFrame(e, columns=["source", "target", "weight", "shape", "forward", "reverse"]))))
    return out, cell


def test_costs_are_those_of_a_plain_search():
    fewer = plain = 0
    for seed in range(6):
        nodes, links = lattice(seed)
        graph = as_graph(nodes, links)
        rng = random.Random(seed)
        for _ in range(40):
            s, t = rng.randrange(49), rng.randrange(49)
            got, want = routing.route(graph, s, t), graph.ahead.path(s, t)[0]
            assert got.cost == want and got.status == ("no-route" if want is None else "complete")
            if want:
                assert got.path[0] == s and got.path[-1] == t and sum(links[p] for p in zip(got.path, got.path[1:])) == want
                fewer, plain = fewer + got.settled, plain + graph.ahead.settled(s, t)
    assert fewer < plain


def test_statuses():
    nodes, links = lattice(1, one_way=0.0)
    graph = as_graph(nodes, links)
    assert routing.route(graph, 3, 3) == routing.Route("complete", 0, [3])
    assert routing.route(graph, 3, 999).status == "no-route"
    assert routing.route(graph, 0, 48, most_settled=2).status == "budget-exceeded"
    assert routing.route(as_graph(nodes, links, {k: k % 2 for k in nodes}), 0, 1) == routing.Route("no-route")
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            routing.route(graph, 0, 1, most_settled=bad)
    for cost in (lambda a, b, w: w - 1, lambda a, b, w: 21 * w, lambda a, b, w: w + 0.5):
        with pytest.raises(ValueError):
            routing.route(graph, 0, 48, cost)
    doubled = routing.route(graph, 0, 48, lambda a, b, w: 2 * w)
    assert doubled.cost == 2 * routing.route(graph, 0, 48).cost
    exact = as_graph({1: (0.0, 0.0), 0: (0.0, 0.0)}, {(1, 0): 2})
    assert routing.route(exact, 1, 0).cost == 2 and routing.route(exact, 0, 1).status == "no-route"
    inner = routing.Within(graph, (77.2, 28.6, 77.2 + 3 * STEP + 1e-9, 28.6 + 3 * STEP + 1e-9))
    got = routing.route(inner, 0, 24)
    assert routing.route(inner, 0, 48).status == "no-route" and all(graph.position(k)[0] <= 28.6 + 3.1 * STEP for k in got.path)


def test_tiles_come_and_go():
    nodes, links = lattice(2, n=12, one_way=0.0)
    tiles, cell = tiles_of(nodes, links)
    assert len(tiles) > 2
    whole = TileSet()
    for t in tiles:
        whole.add(t)
        whole.add(t)
    assert len(whole) == len(tiles) and whole.capacity >= len(nodes) and tiles[0].cell in whole
    graph = as_graph(nodes, links)
    for s, t in ((0, 143), (5, 100), (77, 3)):
        assert routing.route(whole, s, t).cost == graph.ahead.path(s, t)[0]
    for k in (0, 40, 143):
        for backwards in (False, True):
            assert sorted(whole.arcs(k, backwards)) == sorted(graph.arcs(k, backwards))
    other = tilecodec.Tile(bytes(tiles[0].blob))
    with pytest.raises(tilecodec.TileError):
        whole.add(other)
    # Tiles are loaded as the search asks for them, until the route is complete.
    some = TileSet()
    some.add(next(t for t in tiles if t.cell == cell[0]))
    by = {t.cell: t for t in tiles}
    assert some.component(0) == 0 and some.component(143) == -1 and routing.route(some, 0, 143).status == "no-route"
    some.add(by[cell[143]]) if cell[143] not in some else None
    for _ in range(len(tiles)):
        got = routing.route(some, 0, 143)
        if got.status == "complete":
            break
        assert got.status == "missing-tiles" and got.missing and not got.missing & set(some.loaded)
        for c in got.missing:
            some.add(by[c])
    assert got.status == "complete" and got.cost == graph.ahead.path(0, 143)[0]
    halo = next(k for k in nodes if cell[k] != cell[0] and some.resolve(k))
    some.remove(cell[halo])
    assert cell[halo] not in some and (some.resolve(halo) is None or some.owner_missing(halo) == cell[halo]) and not list(some.arcs(halo, False))
    some.clear()
    assert len(some) == 0 and some.position(0) is None


def test_escape():
    nodes, links = lattice(3, one_way=0.0)
    graph = as_graph(nodes, links)
    got = routing.escape(graph, [0, 48])
    ids, cost = search.PackedGraph(*(np.array(x, np.int64) for x in zip(*((b, a, w) for (a, b), w in links.items())))).distances(np.array([0, 48]))
    assert got.status == "complete" and got.cost == dict(zip(ids.tolist(), cost.tolist())) and got.next[0] == 0
    assert all(got.cost[k] == links[k, n] + got.cost[n] for k, n in got.next.items() if k != n)
    assert routing.escape(graph, [0], most_settled=3).status == "budget-exceeded"
    assert routing.escape(graph, []).status == "unknown-endpoints" and routing.escape(graph, [0, 999]).status == "unknown-endpoints"
    tiles, cell = tiles_of(nodes, links)
    one = TileSet()
    one.add(next(t for t in tiles if t.cell == cell[0]))
    part = routing.escape(one, [0])
    assert len(tiles) == 1 or (part.status == "missing-tiles" and part.missing)


def test_weights_below_the_distance_are_refused():
    nodes = pd.DataFrame({"node_id": [1, 2], "lat": [28.6, 28.601], "lon": [77.2, 77.2], "component": [0, 0], "halo": [False, False], "junction": [False, False]})
    edges = pd.DataFrame({"source": [1], "target": [2], "weight": [5], "shape": [[]], "forward": [True], "reverse": [True]})
    with pytest.raises(tilecodec.TileError):
        tilecodec.Tile(tilecodec.encode_tile(tilecodec.cell_of(28.6, 77.2), nodes, edges))
