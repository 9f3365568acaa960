import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from pyspark.sql import functions as F

from lanternway.functions.lines import cumulative_metres, lengths_of, metres_between, project_on, turns
from lanternway.operators import guidance as G
from lanternway.operators import snap
from lanternway.runtime import Scratch
from lanternway.sources import elements, packs, tilecodec
from lanternway.streaming.guidance import run_to_end

CELL = "ttnfsw"


def tile():
    nodes = pd.DataFrame({"node_id": [4, 1, 9], "lat": [28.6, 28.601, 28.602], "lon": [77.2, 77.201, 77.202], "component": [0, 0, 1], "halo": [False, False, True], "junction": [True, False, False]})
    shape = [(28.6005, 77.2005), (28.6007, 77.2006)]
    edges = pd.DataFrame({"source": [4, 1, 1, 4], "target": [1, 4, 9, 4], "weight": [10000, 10000, 7000, 3], "shape": [shape, shape[::-1], [], []], "forward": [True] * 4, "reverse": [True, True, False, True]})
    return nodes, edges


def test_tile_round_trip():
    nodes, edges = tile()
    blob = tilecodec.encode_tile(CELL, nodes, edges)
    cell, n, e = tilecodec.decode_tile(blob)
    assert cell == CELL and n["node_id"].tolist() == [1, 4, 9] and n["halo"].tolist() == [False, False, True]
    got = {(r.source, r.target, r.weight, len(r.shape)) for r in e.itertuples()}
    assert got == {(4, 1, 10000, 2), (1, 4, 10000, 2), (1, 9, 7000, 0), (4, 4, 3, 0)}
    a, b = (e[(e.source == s) & (e.target == t)]["shape"].iloc[0] for s, t in ((4, 1), (1, 4)))
    assert a == b[::-1]
    assert blob == tilecodec.encode_tile(CELL, nodes.iloc[::-1], edges.iloc[::-1])


@pytest.mark.parametrize("damage", ["short", "magic", "length", "id", "weight"])
def test_damaged_tiles_are_refused(damage):
    blob = bytearray(tilecodec.encode_tile(CELL, *tile()))
    if damage == "short":
        blob = blob[:40]
    elif damage == "magic":
        blob[0] ^= 1
    elif damage == "length":
        blob += b"\0"
    elif damage == "id":
        blob[64 + 24 : 64 + 28] = (99).to_bytes(4, "little")
    else:
        at = 64 + 15 * 3 + (-(64 + 45)) % 4 + 16 + 16
        blob[at : at + 4] = b"\0" * 4
    with pytest.raises(tilecodec.TileError):
        tilecodec.decode_tile(bytes(blob))


def test_publish_verify_prune(spark, tmp_path):
    blob = bytearray(tilecodec.encode_tile(CELL, *tile()))
    tiles = spark.createDataFrame([(CELL, blob)], "cell string, blob binary")
    drawing = {"version": 1, "bounds": [77.0, 28.0, 78.0, 29.0], "roads": [{"kind": "path", "points": [[77.2, 28.6], [77.3, 28.6]]}], "labels": []}
    region, root = {"id": "r", "bounds": [77.0, 28.0, 78.0, 29.0]}, f"file://{tmp_path}/packs"
    one = packs.publish(tiles, drawing, region, "a" * 64, "2026-01-01T00:00:00Z", root)
    again = packs.publish(tiles, drawing, region, "a" * 64, "2026-01-01T00:00:00Z", root)
    assert one == again and one["totalBytes"] == sum(a["bytes"] for a in one["assets"])
    two = packs.publish(tiles, drawing, region, "b" * 64, "2026-01-02T00:00:00Z", root)
    assert two["datasetId"] != one["datasetId"] and packs.active(spark, root, "r") == two["datasetId"]
    assert packs.verify(spark, root, "r", one["datasetId"]).count() == 0
    m = spark.read.json(spark.sparkContext.parallelize([packs.canonical_json(two).decode()]))
    assert packs.manifest_violations(m, spark.createDataFrame([("r", region["bounds"])], "id string, bounds array<double>")).count() == 0
    other = spark.createDataFrame([(CELL, blob + b"x")], "cell string, blob binary")
    packs.assets_of(other, packs.canonical_json(drawing)).write.mode("overwrite").parquet(f"{root}/r/{one['datasetId']}/assets")
    assert [r.problem for r in packs.verify(spark, root, "r", one["datasetId"]).collect()] == ["differs"]
    assert packs.prune(spark, root, "r") == [one["datasetId"]]
    with pytest.raises(FileNotFoundError):
        packs.read_manifest(spark, root, "r", one["datasetId"])
    with pytest.raises(ValueError):
        packs.publish(tiles, drawing | {"labels": [{}] * 10_001}, region, "c" * 64, "2026-01-02T00:00:00Z", root)


def test_responses(spark, tmp_path):
    import gzip
    import json

    body = {"osm3s": {"timestamp_osm_base": "2026-01-01T00:00:00Z"}, "elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 5, "nodes": [1, 3], "tags": {"highway": "path"}}]}
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump(body, f)
    (tmp_path / "b.json").write_text(json.dumps(body | {"remark": "cut"}))
    whole = elements.complete_responses(elements.read_responses(spark, str(tmp_path / "a.json.gz")))
    nodes, ways = elements.split_elements(whole)
    assert nodes.count() == 1 and [tuple(r) for r in elements.missing_references(ways, nodes).collect()] == [(5, 3)]
    with pytest.raises(Exception, match="incomplete"):
        elements.split_elements(elements.complete_responses(elements.read_responses(spark, str(tmp_path / "b.json"))))[0].collect()


def network(spark, edges, nodes):
    e = spark.createDataFrame(edges, "edge_id long, source long, target long, weight long, shape array<struct<lat:float,lon:float>>")
    return Scratch(spark, "t").keep(snap.roads_of(e, spark.createDataFrame(nodes, "node_id long, lat double, lon double")))


def test_projection_equals_brute_force(spark):
    rng = random.Random(4)
    nodes = [(i, 28.6 + rng.random() / 100, 77.2 + rng.random() / 100) for i in range(12)]
    edges = [(k, rng.randrange(12), rng.randrange(12), 5, [(28.6 + rng.random() / 100, 77.2 + rng.random() / 100)] * rng.randrange(2)) for k in range(15)]
    roads = network(spark, edges, nodes)
    points = [(i, 28.6 + rng.random() / 90, 77.2 + rng.random() / 90) for i in range(40)] + [(99, None, 1.0)]
    got = {(r.point_id, r.edge_id): (r.distance, r.along) for r in snap.projections(spark.createDataFrame(points, "point_id long, lat double, lon double"), roads).collect()}
    want = {}
    for r in roads.collect():
        line = [(p.lat, p.lon) for p in r.points]
        assert r.lengths == pytest.approx(lengths_of(line))
        for i, lat, lon in points[:-1]:
            d, along, *_ = project_on((lat, lon), line, lengths_of(line))
            if d <= snap.REACH_M:
                want[i, r.edge_id] = (d, along)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_walks(spark):
    # a straight two-way path 1-2, a one-way path 2->3, a path 8-9 apart, and two that cross without a junction
    nodes = [(1, 0.0, 0.001), (2, 0.0, 0.003), (3, 0.0, 0.005), (8, 1.0, 1.0), (9, 1.0, 1.002), (20, 2.0, 2.0), (21, 2.0, 2.002), (22, 1.999, 2.001), (23, 2.001, 2.001)]
    edges = [(1, 1, 2, 20000, []), (2, 2, 1, 20000, []), (3, 2, 3, 20000, []), (4, 8, 9, 20000, []), (5, 9, 8, 20000, []), (6, 20, 21, 9, []), (7, 22, 23, 9, [])]
    p = lambda lat, lon: (lat, lon)
    asks = [(1, p(0.0, 0.0015), p(0.0, 0.0045)), (2, p(0.0, 0.0045), p(0.0, 0.0015)), (3, p(0.0, 0.0015), p(1.0, 1.001)), (4, p(0.0, 0.0015), p(0.1, 0.1)), (5, p(0.0, 0.0015), p(0.0, 0.0015001)), (6, p(2.0, 2.001), p(0.0, 0.0015)), (7, p(0.0, 0.0015), p(99.0, 0.0)), (8, p(0.00001, 0.003), p(0.0, 0.0015))]
    df = spark.createDataFrame(asks, "request_id long, start struct<lat:double,lon:double>, destination struct<lat:double,lon:double>")
    got = {r.request_id: r for r in snap.plan_walks(df, network(spark, edges, nodes)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "no-route", 3: "no-route", 4: "too-far", 5: "together", 6: "overlap", 7: "invalid-point", 8: "ok"}
    assert got[1].cost == pytest.approx(15000 + 15000, rel=1e-4) and got[1].metres == pytest.approx(metres_between((0, 0.0015), (0, 0.0045)), rel=1e-6)
    assert [(round(q.lat, 6), round(q.lon, 6)) for q in got[1].points] == [(0, 0.0015), (0, 0.003), (0, 0.0045)]
    assert got[8].cost == pytest.approx(15000, rel=1e-3)


def test_sinks(spark, tmp_path):
    """Pointer, lease, forgetting, half-done runs, withdrawal and catalogue."""
    root = f"file://{tmp_path}/packs"
    packs._write_text(spark, f"{root}/r/ACTIVE", "one")
    packs._write_text(spark, f"{root}/r/ACTIVE", "two")
    assert packs.active(spark, root, "r") == "two" and sorted(p.name for p in (tmp_path / "packs" / "r").iterdir() if not p.name.startswith(".")) == ["ACTIVE"]
    assert not packs.forget(spark, root, "r", "one") and packs.forget(spark, root, "r", "two") and packs.active(spark, root, "r") is None
    assert packs.check_active(spark, root, "r") == ["none active"]
    clock = [0.0]
    with packs.lease(spark, root, "r", "a", now=lambda: clock[0]):
        with packs.lease(spark, root, "r", "a", now=lambda: clock[0]):
            pass
        with packs.lease(spark, root, "r", "a", now=lambda: clock[0]):
            with pytest.raises(PermissionError):
                with packs.lease(spark, root, "r", "b", now=lambda: clock[0]):
                    pass
            clock[0] = 46.0
            with packs.lease(spark, root, "r", "b", now=lambda: clock[0]):
                pass
    (tmp_path / "packs" / "r" / "_staging-x").mkdir()
    assert packs.clear_partial(spark, root, "r") == 1 and packs.clear_partial(spark, root, "gone") == 0
    packs.remove(spark, root, "r")
    assert not (tmp_path / "packs" / "r").exists()
    with pytest.raises(ValueError):
        packs.write_catalogue(spark, f"{root}/catalog.json", [])


def test_damage_withdraws_a_generation(spark, tmp_path):
    tiles = spark.createDataFrame([(CELL, bytearray(tilecodec.encode_tile(CELL, *tile())))], "cell string, blob binary")
    region = {"id": "r", "name": "R", "subtitle": "", "coverageLabel": "", "bounds": [77.0, 28.0, 78.0, 29.0]}
    drawing, root = {"version": 1, "bounds": region["bounds"], "roads": [{"kind": "path", "points": [[77.2, 28.6], [77.3, 28.6]]}], "labels": []}, f"file://{tmp_path}/packs"
    one = packs.publish(tiles, drawing, region, "a" * 64, "2026-01-01T00:00:00Z", root)
    assert packs.check_active(spark, root, "r") == []
    entry = packs.catalogue_entry(region, one, packs.digest(packs.canonical_json(one)), drawing)
    packs.write_catalogue(spark, f"{root}/catalog.json", [entry])
    listed = spark.createDataFrame([("r", region["bounds"], one["datasetId"], one["totalBytes"])], "id string, bounds array<double>, datasetId string, totalBytes long")
    m = spark.read.json(spark.sparkContext.parallelize([packs.canonical_json(one).decode()]))
    assert packs.manifest_violations(m, listed).count() == 0
    assert {r.violation for r in packs.manifest_violations(m.withColumn("totalBytes", F.lit(1)), listed.withColumn("datasetId", F.lit("x"))).collect()} == {"generation", "total"}
    packs.assets_of(tiles, b"{}").write.mode("overwrite").parquet(f"{root}/r/{one['datasetId']}/assets")
    assert packs.check_active(spark, root, "r") == ["map.json: differs"] and packs.active(spark, root, "r") is None


def test_drawings(spark):
    schema = "version int, bounds array<double>, roads array<struct<kind:string,points:array<array<double>>>>, labels array<struct<text:string,point:array<double>>>"
    good = (1, [0.0, 0.0, 1.0, 1.0], [("path", [[0.1, 0.1], [0.2, 0.2]])], [("a", [0.1, 0.1])])
    bad = (2, [1.0, 0.0, 0.0, 1.0], [(None, [[0.1, 0.1]])], [("x" * 151, [200.0, 0.0])])
    codes = [sorted(r.violation for r in packs.drawing_violations(spark.createDataFrame([d], schema)).collect()) for d in (good, bad)]
    assert codes == [[], ["bounds", "label", "road", "version"]]


def test_turns(spark):
    line = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0011, 0.001), (0.0011, 0.0002), (0.0012, 0.0002)]
    rows = [(1, [{"lat": a, "lon": b} for a, b in line]), (2, [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 0.001}]), (3, [{"lat": 0.0, "lon": x} for x in (0.0, 0.001, 0.0)])]
    df = spark.createDataFrame(rows, "k int, points array<struct<lat:double,lon:double>>").withColumn("lengths", cumulative_metres(F.col("points")))
    got = {r.k: r.t for r in df.select("k", turns(F.col("points"), F.col("lengths")).alias("t")).collect()}
    assert [t["what"] for t in got[1]] == ["start", "right", "left", "arrive"]
    assert [t["what"] for t in got[2]] == ["start", "arrive"] and [t["what"] for t in got[3]] == ["start", "back", "arrive"]
    assert got[1][-1]["along"] == pytest.approx(lengths_of(line)[-1])


def test_overlapping_candidates(spark):
    """A shared junction within reach settles a point, two ends of a path of a few centimetres are one node, and a hub of too many paths is an overlap."""
    nodes = [(1, 0.0, 0.001), (2, 0.0, 0.002), (3, 0.001, 0.001), (4, 0.0, 0.0010000001), (5, -0.001, 0.0010000001), (50, 5.0, 5.0)] + [(60 + k, 5.0 + 0.001 * k, 5.001) for k in range(1, 27)]
    edges = [(1, 1, 2, 10, []), (2, 2, 1, 10, []), (3, 1, 3, 10, []), (6, 1, 4, 1, []), (7, 4, 5, 10, [])] + [(60 + k, 50, 60 + k, 10, []) for k in range(1, 27)]
    roads = network(spark, edges, nodes)
    points = spark.createDataFrame([(1, 0.00000001, 0.00100001), (2, -0.000000001, 0.00099), (3, 5.0, 4.99999)], "point_id long, lat double, lon double")
    got = snap.settle(points, roads, Scratch(spark, "t").keep(snap.nearest_paths(points, roads))).collect()
    by = {p: [r for r in got if r.point_id == p] for p in (1, 2, 3)}
    assert {r.status for r in by[1]} == {"ok"} and {(round(r.lat, 6), round(r.lon, 6)) for r in by[1]} == {(0.0, 0.001)} and len(by[1]) == 5
    assert {r.status for r in by[2]} == {"ok"} and [r.status for r in by[3]] == ["overlap"]


def test_guidance_batch_and_stream_agree(spark):
    rng = random.Random(6)
    t0 = datetime(2026, 1, 1)
    line = [(0.0, k * 0.0005) for k in range(10)]
    routes = spark.createDataFrame([(s, [{"lat": a, "lon": b} for a, b in line]) for s in (1, 2, 3)], "session_id long, points array<struct<lat:double,lon:double>>")
    rows = []
    for s in (1, 2, 3, 4):
        for k in range(60):
            at = t0 + timedelta(seconds=2 * k)
            rows.append((s, 100 * s + k, rng.gauss(0, 2e-5) + (0.01 if k == 20 else 0), min(0.0045, k * 0.0001), rng.choice([5.0, 10.0, 60.0, float("nan"), -1.0]) if k < 45 else 5.0, at, at + timedelta(seconds=rng.choice([0, 3, 19, 21, -6]) if k < 45 else 0)))
    schema = "session_id long, fix_id long, lat double, lon double, accuracy double, ts timestamp, processed_at timestamp"
    fixes = Scratch(spark, "t").keep(spark.createDataFrame(rows, schema))
    batch = sorted(tuple(r) for r in G.guide(fixes, routes).collect())
    stream = sorted(tuple(r) for r in run_to_end(fixes._scratch_path, fixes.schema, routes).collect())
    assert batch == stream and {r[0] for r in batch} == {1, 2, 3}
    for s in (1, 2, 3):
        mine = [r for r in batch if r[0] == s]
        assert all(a[2] <= b[2] for a, b in zip(mine, mine[1:])) and sum(r[4] for r in mine) <= 1
    assert any(r[4] for r in batch)
