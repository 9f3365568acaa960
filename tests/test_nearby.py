import numpy as np

from lanternway.operators import nearby as N


def brute(rows, metres):
    out = set()
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and abs(r[1]) <= 90 and abs(r[2]) <= 180 and not (r[1] == 0 and r[2] == 0)]
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] != b[0] and N.haversine(a[1], a[2], b[1], b[2]) <= metres:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def cloud(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = [(52.0, 13.0), (-17.0, 179.99999), (-17.0, -179.99999), (89.99999, 10.0), (0.0, 0.00001), (52.00003, 13.00002)]
    rows = []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        lat, lon = c[0] + rng.normal(0, 4e-5), c[1] + rng.normal(0, 4e-5)
        lon = (lon + 180) % 360 - 180
        rows.append((i, float(min(90, lat)), float(lon)))
    return rows + [rows[0], (n, rows[1][1], rows[1][2]), (None, 1.0, 1.0), (n + 1, None, 1.0), (n + 2, float("nan"), 1.0), (n + 3, 0.0, 0.0), (n + 4, 0.0, 0.0), (n + 5, 91.0, 0.0)]


def test_near_pairs(spark):
    for seed, crowd in ((1, 50_000), (2, 20)):  # the second cuts cubes and blocks
        rows = cloud(seed)
        got = [tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, "id long, lat double, lon double"), 4.0, crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 4.0)


def test_crowd_at_one_place(spark):
    rows = [(i, 10.0, 10.0) for i in range(60)]
    assert N.near_pairs(spark.createDataFrame(rows, "id long, lat double, lon double"), 4.0, 10).count() == 60 * 59 // 2


def test_no_points(spark):
    assert N.near_pairs(spark.createDataFrame([], "id long, lat double, lon double"), 4.0).count() == 0


def test_regions(spark):
    regions = [(1, [10.0, 20.0, 11.0, 21.0]), (2, [10.5, 20.5, 10.6, 20.6]), (3, [170.0, -20.0, 190.0, -10.0]), (4, None), (5, [1.0, 2.0, 3.0]), (6, [10.0, float("nan"), 11.0, 21.0]), (7, [-180.0, -90.0, 180.0, 90.0]), (8, [10.0, 20.0, 12.0, 20.0]), (None, [10.0, 20.0, 11.0, 21.0])]
    points = [(1, 20.0, 10.0, None), (2, 20.55, 10.55, "zzz"), (3, 0.0, 0.0, None), (4, None, 1.0, " TTNFV2 "), (5, float("nan"), 1.0, "ailo"), (6, 21.0, 11.0, None), (7, 90.0, 180.0, ""), (8, None, None, None), (None, 20.0, 10.0, None), (1, 20.0, 10.0, None)]
    got = [tuple(r) for r in N.regions_of_points(spark.createDataFrame(points, "point_id long, lat double, lon double, geohash string"), spark.createDataFrame(regions, "region_no long, bounds array<double>")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1, 1), (1, 7), (2, 1), (2, 2), (2, 7), (4, 7), (6, 1), (6, 7), (7, 7)}


def test_many_regions_and_points(spark, monkeypatch):
    """Both ways, by the trees and by cells, against brute force; nested, equal, tiny and touching regions among them."""
    rng = np.random.default_rng(9)
    regions = []
    for k in range(150):
        w, s = float(rng.uniform(-180, 170)), float(rng.uniform(-90, 80))
        size = float(10 ** rng.uniform(-3, 1))
        regions.append((k, [w, s, min(180.0, w + size), min(90.0, s + size)]))
    regions += [(200, regions[0][1]), (201, [-180.0, -90.0, 0.0, 0.0]), (202, [0.0, 0.0, 180.0, 90.0])]
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), None) for i in range(300)]
    points += [(1000 + i, r[1][1], r[1][0], None) for i, r in enumerate(regions)] + [(2000 + i, (r[1][1] + r[1][3]) / 2, r[1][2], None) for i, r in enumerate(regions)]
    want = {(p, k) for p, lat, lon, _ in points if (lat, lon) != (0, 0) for k, (w, s, e, n) in regions if w <= lon <= e and s <= lat <= n}
    frames = spark.createDataFrame(points, "point_id long, lat double, lon double, geohash string"), spark.createDataFrame(regions, "region_no long, bounds array<double>")
    for most in (N.BROADCAST_REGIONS, 10):
        monkeypatch.setattr(N, "BROADCAST_REGIONS", most)
        got = [tuple(r) for r in N.regions_of_points(*frames).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_crowd_leaves_in_pieces(monkeypatch):
    """The pairs of coincident points come out chunk by chunk."""
    tree = N.BoxTree(np.zeros((5000, 3)))
    sizes = [len(i) for i, _, _ in N.dual_tree_pairs(tree, tree, 4.0)]
    assert sum(sizes) == 5000 * 5000 and max(sizes) <= 1_010_000
