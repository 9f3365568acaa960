import random
from collections import Counter, defaultdict

from lanternway.functions import geo, rules
from lanternway.operators import components, network, search
from pyspark.sql import functions as F

WAYS = "way_id long, nodes array<bigint>, tags map<string,string>"
NODES = "id long, lat double, lon double, tags map<string,string>"


def graph(spark, ways, nodes, profile="motor"):
    refs = network.placed_refs(spark.createDataFrame(ways, WAYS), spark.createDataFrame(nodes, NODES), profile)
    return refs, network.segments(refs)


def test_geohash_goldens(spark):
    want = {(57.64911, 10.40744): "u4pruy", (0.0, 0.0): "7zzzzz", (-90.0, -180.0): "000000", (90.0, 180.0): "zzzzzz", (28.6315, 77.2167): "ttnfvh", (28.6129, 77.2295): "ttnfv2"}
    df = spark.createDataFrame(list(want), "lat double, lon double")
    assert {(r.lat, r.lon): r.h for r in df.select("lat", "lon", geo.geohash_encode(F.col("lat"), F.col("lon"), 6).alias("h")).collect()} == want
    b = spark.range(1).select(geo.geohash_box(F.lit(" TTNFV2")).alias("b")).first()["b"]
    assert (b["south"], b["west"], b["north"], b["east"]) == (28.6083984375, 77.222900390625, 28.6138916015625, 77.23388671875)
    assert spark.range(1).select(geo.geohash_box(F.lit("aio"))).first()[0] is None


def test_weights_are_rounded_up_by_segment(spark):
    nodes = [(i + 1, 28.6 + 0.0002 * i, 77.2 + 0.0001 * i, None) for i in range(4)]
    refs, seg = graph(spark, [(1, [1, 2, 3, 4], {"highway": "residential"})], nodes)
    got = sorted((r["source"], r["target"], r["weight"], len(r["shape"])) for r in network.simplify_motor(seg).collect())
    assert got == [(1, 4, 1052, 2), (4, 1, 1052, 2)]


def test_rules(spark):
    posted = {"50": 50.0, "30 mph": 48.28032, "walk": 5.0, "none": None, "signals": None, "abc": None, "0": None, "-10": None, "50 knots": None, "50 mph extra": None, "IN:urban": None, "999": 120.0, "50d": None}
    df = spark.createDataFrame([(k,) for k in posted], "v string")
    assert {r.v: r.k for r in df.select("v", rules.maxspeed_kph(F.col("v")).alias("k")).collect()} == posted
    cases = [
        ({"highway": "primary", "access": "no", "vehicle": "yes"}, True, False), ({"highway": "primary", "access": "no", "motor_vehicle": "unknown"}, False, False),
        ({"highway": "primary", "vehicle": " NO "}, False, True), ({"highway": "footway"}, False, True), ({"highway": "motorway"}, True, False), ({"highway": "trunk", "foot": "yes"}, True, True),
        ({"highway": "path", "foot": "yes", "access": "private"}, False, True), ({"highway": "path", "opening_hours": "9-17"}, False, False), ({"highway": "path", "ford": "yes"}, False, False), ({"highway": "service", "access": "destination"}, False, False), ({}, False, False), (None, False, False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t map<string,string>")
    got = {r.i: (r.m, r.w) for r in df.select("i", rules.motor_access(F.col("t")).alias("m"), rules.walkable(F.col("t")).alias("w")).collect()}
    assert got == {i: (m, w) for i, (_, m, w) in enumerate(cases)}
    ways = {"-1": (False, True), "yes": (True, False), "no": (True, True), "maybe": (True, True)}
    df = spark.createDataFrame([(k,) for k in ways], "v string")
    assert {r.v: tuple(r.d) for r in df.select("v", rules.motor_direction(F.create_map(F.lit("oneway"), F.col("v"))).alias("d")).collect()} == ways


def collapse(edges, keep):
    """Chain walk by hand: edges are (source, target, weight)."""
    out_of = defaultdict(list)
    for k, e in enumerate(edges):
        out_of[e[0]].append(k)
    seen, made = set(), []
    for k, e in enumerate(edges):
        if e[0] not in keep or k in seen:
            continue
        seen.add(k)
        total, prev, at, hops = e[2], e[0], e[1], 0
        while at not in keep:
            (n,) = [x for x in out_of[at] if edges[x][1] != prev]
            seen.add(n)
            total, prev, at, hops = total + edges[n][2], at, edges[n][1], hops + 1
        made.append((e[0], at, total, hops))
    return Counter(made + [(*e, 0) for k, e in enumerate(edges) if k not in seen])


def kept(edges):
    ins, outs = defaultdict(list), defaultdict(list)
    for a, b, _ in edges:
        outs[a].append(b)
        ins[b].append(a)
    keep = set()
    for v in set(ins) | set(outs):
        o, i = outs[v], ins[v]
        if not o or not i:
            keep.add(v)
        elif len(o) == 1 and len(i) == 1:
            if set(o) == set(i):
                keep.add(v)
        elif not (len(o) == 2 and len(i) == 2 and set(o) == set(i) and len(set(o)) == 2):
            keep.add(v)
    return keep


def random_ways(seed, n=25):
    rng = random.Random(seed)
    nodes = [(i, 10 + rng.random() / 10, 20 + rng.random() / 10, None) for i in range(90)]
    ways = []
    for w in range(n):
        line = [rng.randrange(100) if rng.random() > 0.05 else None for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.2 and line:
            line.append(line[-1])
        ways.append((w, line, {"highway": "residential", "oneway": rng.choice(["yes", "no", "-1"]), "oneway:foot": rng.choice(["yes", "no", "-1"])}))
    ways.append((n, [70, 71, 72, 70], {"highway": "residential", "oneway": "yes"}))
    nodes += [(200 + k, 5.0 + k / 100, 5.0 + (k % 2) / 100, None) for k in range(4)]
    ways.append((n + 1, [200, 201, 202, 203, 200], {"highway": "residential"}))  # an isolated ring
    return ways, nodes


def test_motor_simplification_equals_a_chain_walk(spark):
    for seed in (1, 2):
        ways, nodes = random_ways(seed)
        _, seg = graph(spark, ways, nodes)
        edges = [(r.source, r.target, r.weight) for r in seg.collect()]
        got = Counter((r.source, r.target, r.weight, len(r.shape)) for r in network.simplify_motor(seg).collect())
        assert got == collapse(edges, kept(edges))


def test_walking_simplification_keeps_way_ends(spark):
    ways, nodes = random_ways(3)
    refs, seg = graph(spark, ways, nodes, "walking")
    edges = [(r.source, r.target, r.weight) for r in seg.collect()]
    often = {r.node_id for r in network.occurrences(refs).where("way_count > 1").collect()}
    got = Counter((r.source, r.target, r.weight, len(r.shape)) for r in network.simplify_walking(refs).collect())
    assert got == collapse(edges, kept(edges) | often)


def test_components_and_ranks(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node_id: r.root for r in components.connected_components(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(5000,)], "node_id long")).collect()}
    assert got == {x: find(x) for x in parent} | {5000: 5000}
    m = spark.createDataFrame([(k, r) for k, r in got.items()], "node_id long, root long").withColumn("first_seen", F.col("node_id"))
    ranks = {r.node_id: r.component for r in components.ranked_components(m).collect()}
    sizes = Counter(got.values())
    order = sorted(sizes, key=lambda r: (-sizes[r], r))
    assert ranks == {k: order.index(r) for k, r in got.items()}


def test_both_searches_agree(spark):
    rng = random.Random(8)
    edges = [(i, rng.randrange(40), rng.randrange(40), rng.randrange(1, 60)) for i in range(120)]
    df = spark.createDataFrame(edges, "edge_id long, source long, target long, weight long")
    asks = spark.createDataFrame([(i, rng.randrange(44), rng.randrange(44)) for i in range(25)] + [(90, None, 3), (91, 999, 999)], "request_id long, source long, target long")
    a, b = (search.shortest_paths(df, asks, kernel=k) for k in (True, False))
    rows = lambda x: {r.request_id: (r.status, r.cost) for r in x.collect()}
    assert rows(a) == rows(b)
    for paths in (a, b):
        sums = {r.request_id: r.total for r in search.path_sums(paths, df).collect()}
        assert all(sums[r.request_id] == r.cost and r.path[0] == r.source and r.path[-1] == r.target for r in paths.where("status = 'complete'").collect())
    exits = spark.createDataFrame([(3,), (9,), (9,), (None,), (777,)], "node_id long")
    one, two = ({tuple(r) for r in search.nearest_exit(df, exits, kernel=k).collect()} for k in (True, False))
    assert one == two and (777, 0, 777) in one
