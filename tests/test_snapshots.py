from datetime import datetime

from lanternway.operators.snapshots import snapshot_changes
from lanternway.sources.elements import ELEMENT

SNAP = f"region_id string, dataset_id string, part_no int, delivered_at timestamp, remark string, elements array<{ELEMENT}>, h string"
MAN = "datasetId string, source struct<timestamp:string>, region_id string"
D = datetime(2026, 1, 1)


def node(i, lat=1.0, lon=2.0, tags=None):
    return ("node", i, lat, lon, None, tags)


def test_changes_and_noise(spark):
    snaps = [
        ("r", "a", 0, D, None, [node(1), node(2), node(3), ("way", 1, None, None, [1, 2], {"k": "v"})], "x"),
        ("r", "b", 0, D, " ", [node(1, 1.00000001, 2.0, {}), node(2, tags={"a": "b"})], "x"),
        ("r", "b", 1, D, None, [node(2, tags={"a": "b"}), node(4), ("way", 1, None, None, [2, 1], {"k": "v"}), (None, 9, 1.0, 1.0, None, None)], "x"),
        ("r", "bad", 0, D, "cut off", [node(77)], "x"),
        ("r", "orphan", 0, D, None, [node(78)], "x"),
        ("r", "c", 0, D, None, None, "x"),
    ]
    mans = [("a", ("2026-01-01T00:00:00Z",), "z"), ("b", ("2026-01-01T05:29:00+05:30",), "z"), ("bad", ("2026-01-02T00:00:00Z",), "z"), ("c", ("2026-01-03T00:00:00.5Z",), "z"), ("c", ("2026-01-03T00:00:00.5Z",), "z"), ("late", ("soon",), "z")]
    # b is one minute before a by its instant, so the order is b, a, c
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(mans, MAN)).collect()}
    want = {("r", "a", "node", 3, "added"), ("r", "a", "node", 4, "removed"), ("r", "a", "node", 2, "changed"), ("r", "a", "way", 1, "changed")}
    want |= {("r", "c", "node", i, "removed") for i in (1, 2, 3)} | {("r", "c", "way", 1, "removed")}
    assert got == want


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAP), spark.createDataFrame([], MAN)).count() == 0
