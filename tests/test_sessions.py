from datetime import datetime, timedelta

from lanternway.plans import service

POINT = "struct<lat:double,lon:double>"


def test_sessions_are_dealt_over_all_edges(spark, tmp_path, monkeypatch):
    """No edge number is divisible by 100 here; each user has another edge, those of under 3 m none."""
    edges = [(100 * k + 1, [{"lat": 0.001 * k, "lon": 0.0}, {"lat": 0.001 * k, "lon": 0.0005}], 2.0 if k == 3 else 55.0) for k in range(7)]
    monkeypatch.setattr(service, "_roads", lambda s, d: s.createDataFrame(edges, f"edge_id long, points array<{POINT}>, metres double"))
    at = datetime(2026, 1, 1)
    events = [(10 * u + k, at + timedelta(seconds=k), u, "x", 5.0) for u in range(12) for k in range(3)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    fixes, routes = service._sessions(spark, str(tmp_path))
    usable = [p[0]["lat"] for _, p, metres in edges if metres >= 3]
    assert {r.session_id: r.points[0].lat for r in routes.collect()} == {u: usable[u % 6] for u in range(12)}
    assert fixes.count() == len(events)
    assert {r.session_id for r in service.guidance_batch(spark, str(tmp_path)).collect()} == set(range(12))
