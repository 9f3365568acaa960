import random

from lanternway.operators import search


def test_both_searches_give_the_same_path_among_ties(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(30), rng.randrange(30), rng.randrange(1, 3)) for i in range(150)]
    edges += [(200, 900, 912, 1), (201, 900, 911, 2), (202, 912, 990, 2), (203, 911, 990, 1)]  # 912 is found first
    df = spark.createDataFrame(edges, "edge_id long, source long, target long, weight long")
    asks = spark.createDataFrame([(i, rng.randrange(30), rng.randrange(30)) for i in range(40)] + [(90, 900, 990)], "request_id long, source long, target long")
    a, b = ({r.request_id: r.path for r in search.shortest_paths(df, asks, kernel=k).collect()} for k in (True, False))
    assert a == b and a[90] == [900, 911, 990]
