import random

from lanternway.llm.groups import connected_groups


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def run(spark, edges):
    rows = [(a, b, "x") for a, b in edges]
    got = connected_groups(spark.createDataFrame(rows, "source long, target long, node_id string")).collect()
    assert len(got) == len({r.node_id for r in got})
    return {r.node_id: r.group_id for r in got}


def test_random_chain_and_hub(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(i, i + 1) for i in range(1000, 1150)] + [(2000, 2001 + i) for i in range(300)] + edges[:20]
    edges += [(-5, 9_000_000_000), (7, 7), (5000, 5000), (None, 1), (2, None)]
    assert run(spark, edges) == brute(edges)


def test_empty_and_only_loops(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), (3, 3)]) == {3: 3}
