"""Graphs that are more than the driver should hold go to tasks by component, with equal results."""

import random

import pytest

from lanternway.operators import routing, search


@pytest.fixture(scope="module")
def graph(spark):
    """Twelve components of a few nodes, requests inside, between and outside of them."""
    rng = random.Random(5)
    places = {k: (28.6 + (k % 10) * 0.0008, 77.2 + (k // 10) * 0.0008) for k in range(120)}
    links = {}
    for k in range(120):
        for other in rng.sample(range(k // 10 * 10, k // 10 * 10 + 10), 3):
            if other != k:
                links[k, other] = routing.least_weight(places[k], places[other]) + rng.randrange(1, 5) * 100
    asks = [(n, rng.randrange(60), rng.randrange(60)) for n in range(200)] + [(n, k, k // 10 * 10 + n % 10) for n, k in enumerate(range(120), 200)] + [(900, None, 3), (901, 4, None), (902, 777, 777), (903, 5, 777), (904, 6, 6)]
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "source long, target long, weight long")
    nodes = spark.createDataFrame([(k, *at, k // 10) for k, at in places.items() if k != 17], "node_id long, lat double, lon double, component long")
    return edges, nodes, spark.createDataFrame(asks, "request_id long, source long, target long")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def refuse(*_):
    raise AssertionError("the graph went through the driver")


@pytest.mark.parametrize("limits", [{"GROUP_EDGES": 5, "GROUP_WORK": 50}, {"GROUP_ASKED": 3, "KERNEL_EDGES": 27}])
def test_paths(graph, monkeypatch, limits):
    edges, _, asks = graph
    columns = ("request_id", "source", "target", "status", "cost", "path")
    want = rows(search.shortest_paths(edges, asks), *columns)
    assert len(want) == 325 and len({r[3] for r in want}) == 2
    for name, value in {"DRIVER_EDGES": 0, **limits}.items():
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(type(edges), "toPandas", refuse)
    assert rows(search.shortest_paths(edges, asks), *columns) == want


@pytest.mark.parametrize("limits", [{"GROUP_EDGES": 5, "GROUP_WORK": 50}, {"KERNEL_EDGES": 37}])
def test_routes(graph, monkeypatch, limits):
    edges, nodes, asks = graph
    links = search.costed(edges)
    columns = ("request_id", "source", "target", "status", "cost") + (() if "KERNEL_EDGES" in limits else ("path", "settled", "settled_plain"))
    want = rows(routing.routes(links, nodes, asks), *columns)
    for name, value in {"DRIVER_EDGES": 0, **limits}.items():
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(type(edges), "toPandas", refuse)
    assert rows(routing.routes(links, nodes, asks), *columns) == want
    if "KERNEL_EDGES" in limits:
        with pytest.raises(ValueError):
            routing.routes(links, nodes, asks, most_settled=5)


@pytest.mark.parametrize("name", ["shortest_path_check", "plan_walk"])
def test_queries(spark, monkeypatch, name):
    from lanternway.plans import routing as plans

    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = rows(df, *df.columns)
    monkeypatch.setattr(search, "DRIVER_EDGES", 0)
    monkeypatch.setattr(type(df), "toPandas", refuse)
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows(df, *df.columns) == want and want
