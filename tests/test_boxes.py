"""Boxes of the catalogue: every valid region counts, whatever its size and place."""

from math import ceil

from lanternway.functions.geo import GEOHASH_ALPHABET
from lanternway.plans import network as plans

BOUNDS = {1: [10.0, 20.0, 10.1, 20.05], 2: [-97.5, 4.3, -94.997, 6.8], 3: [81.2, 24.8, 82.2, 25.7], 4: [5.0, 5.0, 4.0, 6.0], 5: None, 6: [179.5, 89.0, 180.0, 90.0]}
VALID = (1, 2, 3, 6)


def regions(spark, path):
    spark.createDataFrame(list(BOUNDS.items()), "region_no int, bounds array<double>").write.parquet(f"{path}/catalog_regions.parquet")


def spelled(x, y):
    """The geohash of five characters with column x and row y."""
    bits = "".join(format(x, "013b")[k // 2] if k % 2 == 0 else format(y, "012b")[k // 2] for k in range(25))
    return "".join(GEOHASH_ALPHABET[int(bits[k : k + 5], 2)] for k in range(0, 25, 5))


def test_cells_of_every_region(spark, tmp_path):
    regions(spark, tmp_path)
    step = 180 / 4096
    at = lambda v, base: max(ceil((v - base) / step) - 1, 0)
    want = {(k, spelled(x, y)) for k in VALID for w, s, e, n in [BOUNDS[k]] for x in range(at(w, -180), at(e, -180) + 1) for y in range(at(s, -90), at(n, -90) + 1)}
    got = [(r.region_no, r.cell) for r in plans.cells_in_box(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(k == 2 for k, _ in got) > 3000


NODES = {1: (20.01, 10.01), 2: (20.02, 10.09), 3: (21.0, 11.0), 4: (5.0, -97.0), 5: (5.0, -95.1), 6: (25.0, 81.3), 7: (0.5, 0.5)}
WAYS = {11: [1, 3], 12: [3, 7], 13: [4, 5, 99], 14: [6, 7], 15: [2, 1], 16: [4, 6]}


def network_tables(spark, path):
    regions(spark, path)
    nodes = [(k, a, o, None, True, 1, 1) for k, (a, o) in NODES.items()]
    spark.createDataFrame(nodes, "id long, lat double, lon double, tags map<string,string>, visible boolean, version int, loaded_at int").write.parquet(f"{path}/osm_nodes.parquet")
    ways = [(k, n, {"highway": "footway" if k == 14 else "residential"}, "r", 1, 1) for k, n in WAYS.items()]
    spark.createDataFrame(ways, "id long, nodes array<long>, tags map<string,string>, region_id string, version int, loaded_at int").write.parquet(f"{path}/osm_ways.parquet")
    edges = [(k, a, b, 5, 1.0, None) for k, (a, b) in enumerate([(1, 2), (1, 3), (3, 7), (5, 4), (4, 6), (6, 7), (6, 5)])]
    spark.createDataFrame(edges, "edge_id long, source long, target long, weight long, metres double, shape array<struct<lat:float,lon:float>>").write.parquet(f"{path}/graph_edges.parquet")


def box(k, west_half=False):
    w, s, e, n = BOUNDS[k]
    return {p for p, (a, o) in NODES.items() if w <= o <= ((w + e) / 2 if west_half else e) and s <= a <= n}


def test_crop_of_every_region(spark, tmp_path):
    network_tables(spark, tmp_path)
    want = set()
    for k in VALID:
        ways = {w for w, n in WAYS.items() if w != 14 and set(n) & box(k)}
        want |= {(k, "way", w) for w in ways} | {(k, "node", n) for w in ways for n in WAYS[w] if n in NODES}
    got = [tuple(r) for r in plans.bbox_crop(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {k for k, *_ in got} == {1, 2, 3}


def test_missing_cells_of_every_region(spark, tmp_path):
    network_tables(spark, tmp_path)
    cell = {r.node_id: r.cell for r in plans._owned(spark, str(tmp_path)).collect()}
    links = {(r.source, r.target) for r in plans._graph_edges(spark, str(tmp_path)).collect()}
    want = {}
    for k in VALID:
        loaded = {cell[p] for p in box(k, True)}
        far = {b for a, b in links | {(b, a) for a, b in links} if cell[a] in loaded and cell[b] not in loaded}
        for p in far:
            want[k, cell[p]] = want.get((k, cell[p]), 0) + 1
    got = {(r.region_no, r.cell): r.n_unresolved for r in plans.missing_cells(spark, str(tmp_path)).collect()}
    assert got == want and {k for k, _ in got} == {1, 2, 3}
