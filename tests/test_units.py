from datetime import datetime, timedelta

import numpy as np

from lanternway.functions import units as U
from lanternway.operators import unitdecode as H

CASES = {
    "50": (50, None), "30 mph": (30, "mph"), "Twenty miles per hour": (20, "mph"), "thirty-five mph": (35, "mph"), "mph 12,5": (12.5, "mph"), "sign 7: 05 mph": (5, "mph"),
    "１３.９ m s-1": (13.9, "m/s"), "8.5 m/s, 2 probes": (8.5, "m/s"), "м": (None, None), "650 м/мин": (650, "m/min"), "300 m/min (4 walkers)": (300, "m/min"), "27 nœuds": (27, "knot"),
    "quay 4: 30,0 kn": (30, "knot"), "km 12: 50 km/h": (50, "km/h"), "5 км/ч": (5, "km/h"), "<= 60,0": (60, None), "~4": (4, None), "ca. 11.0": (11, None), "walk": (None, None), "IN:urban": (None, None),
    "": (None, None), "-10": (-10, None), "45 tenths of km/h": (45, "0.1 km/h"), "none": (None, None), "60.0mph": (60, "mph"), "40 km per hour": (40, "km/h"),
}


def test_written_speeds(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "v string")
    got = {r["v"]: (float(r["n"]) if r["n"] is not None else None, r["u"]) for r in df.select("v", U.speed_number(df.v).alias("n"), U.unit_in(df.v).alias("u")).collect()}
    assert got.pop(None) == (None, None)
    assert got == CASES


def test_prose_and_remarks(spark):
    want = {
        "the authority counts in knots throughout": "knot", "whole tenths of a km/h to avoid decimals": "0.1 km/h", "Plain figures are metres walked in one minute.": "m/min",
        "statute miles per hour where nothing is written": "mph", "figures without a suffix are metres per second": "m/s", "Council register, metric; km/h.": "km/h", "30 m from the well": None, "5 benches": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["u"] for r in df.select("v", U.unit_in_prose(df.v).alias("u")).collect()} == want


def test_conversion_rounds_half_up(spark):
    df = spark.createDataFrame([("7", "mph"), ("0.125", "m/s"), ("450", "0.1 km/h"), ("22", "knot")], "n string, u string")
    got = [r[0] for r in df.select(U.to_kmh_x100(df.n.cast("decimal(18,6)"), df.u)).collect()]
    assert got == [1127, 45, 4500, 4074]


def brute_units(model, x, written, noted, said, first):
    """The cheapest of all ways to give every record a state."""
    import itertools

    cost, unit, level = model.emissions(x, written, noted, said)
    best = None
    for path in itertools.product(range(H.STATES), repeat=len(x)):
        total = 0.0
        for t, u in enumerate(path):
            total += cost[t, u]
            if t and not first[t]:
                jump = level[t, u] - level[t - 1, path[t - 1]]
                total += min(jump**2 / (2 * model.spread**2), H.MOST_JUMP) + model.switch * (u != path[t - 1])
        if best is None or total < best[0] - 1e-9:
            best = (total, path)
    return best[0], [int(unit[t, u]) for t, u in enumerate(best[1])]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for pinned in ([-1, -1, -1, -1], [1, -1, -1, 3], [-1, 2, -1, -1]):
        for cut in (0, 2):
            x = rng.normal(3, 1, 4)
            none = np.full(4, -1)
            first = np.arange(4) == cut
            model = H.Model(switch=2.0)
            assert H.viterbi(model, x, none, np.array(pinned), none, first).tolist() == brute_units(model, x, none, np.array(pinned), none, first)[1]


def test_long_sequences_are_decoded_as_in_one_pass():
    rng = np.random.default_rng(5)
    n = 500
    x, none = rng.normal(3, 1, n), np.full(n, -1)
    noted = np.where(rng.random(n) < 0.1, rng.integers(0, H.STATES, n), -1)
    first = rng.random(n) < 0.02
    first[0] = True
    model = H.Model(switch=3.0)
    cost, unit, level = model.emissions(x, none, noted, none)
    at, back = cost[0], []
    for t in range(1, n):
        way = at[:, None] + model.step(level[t - 1][None], level[t][None], cost[t][None], first[t : t + 1])[0]
        back.append(way.argmin(axis=0))
        at = way.min(axis=0)
    states = [int(at.argmin())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    plain = unit[np.arange(n), states[::-1]]
    assert H.viterbi(model, x, none, noted, none, first).tolist() == plain.tolist()


UNIT_ROWS = "ref_table string, record_id long, device string, at timestamp, number string, written string, noted string, said string"


def decoded(spark, rows, model=None):
    df = spark.createDataFrame(rows, UNIT_ROWS)
    return {r["record_id"]: r["unit"] for r in H.decode_units(df.withColumn("number", df.number.cast("decimal(18,6)")), model).collect()}


def test_switch_is_decoded_from_the_jump(spark):
    t = datetime(2026, 5, 1)
    values = [50, 55, 48, 52, 14, 15, 13.5, 14.2, 14.8, 13.9] * 2
    rows = [("road_records", i, "probe", t + timedelta(minutes=i), str(v), None, "km/h" if i == 0 else None, None) for i, v in enumerate(values[:10])]
    rows += [("road_records", 100, None, None, "30", "mph", None, "km/h"), ("road_records", 101, "x", t, "0", "mph", None, None), ("road_records", 102, "x", t, None, "mph", None, None)]
    got = decoded(spark, rows, H.Model(switch=4.0))
    assert got[100] == "mph" and 101 not in got and 102 not in got
    assert [got[i] for i in range(4)] == ["km/h"] * 4
    assert set(got[i] for i in range(4, 10)) == {"m/s"}


def test_a_device_stays_one_chain_over_midnight(spark):
    t = datetime(2026, 5, 1, 23, 51)
    rows = [("road_records", i, "x", t + timedelta(minutes=i), "12", None, "km/h" if i == 0 else None, None) for i in range(16)]
    got = decoded(spark, rows)
    assert set(got.values()) == {"km/h"} and len(got) == 16


def test_statements_win_whatever_the_figures_say(spark):
    """Written before noted before said, at any value; and the parts a chain is cut into make no difference."""
    rng = np.random.default_rng(3)
    t = datetime(2026, 5, 1)
    rows, want = [], {}
    for i in range(600):
        said, noted, written = (H.UNITS[rng.integers(8)] if rng.random() < p else None for p in (1.0, 0.3, 0.3))
        rows.append(("road_records", i, "hot" if i % 3 else "d%d" % (i % 7), t + timedelta(hours=i), "%.3f" % float(np.exp(rng.normal(3, 3))), written, noted, said))
        want[i] = written or noted or said
    assert decoded(spark, rows) == want


def test_parts_of_a_chain_agree_with_one_pass(spark):
    rng = np.random.default_rng(4)
    t = datetime(2026, 5, 1)
    rows = [("road_records", i, "hot", t + timedelta(hours=i), "%.2f" % float(np.exp(rng.normal(2.6 if i > 200 else 3.9, 0.2))), None, None, None) for i in range(400)]
    model = H.Model(switch=5.0)
    x = np.log([float(r[4]) for r in rows])
    none = np.full(len(rows), -1)
    first = np.arange(len(rows)) == 0
    want = [H.UNITS[k] for k in H.viterbi(model, x, none, none, none, first)]
    got = decoded(spark, rows, model)
    assert [got[i] for i in range(400)] == want and len(set(want)) > 1


def test_no_records(spark):
    assert decoded(spark, []) == {}
