import random
from datetime import datetime, timedelta

import numpy as np

from lanternway.operators import orphans as O

T0 = datetime(2026, 1, 1)
PARENTS = "key long, version int, visible boolean, loaded_at timestamp"
REFS = "record_id long, key long, loaded_at timestamp"


def brute(parents, refs):
    out = set()
    for record, key, t in refs:
        if key is None:
            continue
        rows = [p for p in parents if p[0] == key]
        if not rows:
            reason = "missing"
        else:
            known = [p for p in rows if p[3] is not None and (t is None or p[3] <= t)]
            if not known:
                reason = "late"
            else:
                top = max(-(2**31) if p[1] is None else p[1] for p in known)
                if any(p[2] is not False for p in known if (p[1] if p[1] is not None else -(2**31)) == top):
                    continue
                reason = "deleted"
        out.add(("a", t.strftime("%Y-%m") if t else None, record, key, reason))
    return out


def run(spark, parents, refs):
    got = O.find_orphans(spark.createDataFrame(parents, PARENTS), [("a", spark.createDataFrame(refs, REFS))])
    return {tuple(r) for r in got.collect()}


def random_case(seed, hot=False):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(days=rng.randrange(120))
    parents = [(rng.randrange(40), rng.choice([None, 1, 2, 3]), rng.choice([True, False, None]), rng.choice([None, at(), at(), at()])) for _ in range(90)]
    parents += parents[:5]
    refs = [(i, rng.choice([None, *range(50)]) if not hot or i % 3 else 7, rng.choice([None, *[at()] * 9])) for i in range(300 if not hot else 6000)]
    return parents, refs + refs[:20]


def test_against_brute_force(spark):
    for seed in range(3):
        p, r = random_case(seed)
        assert run(spark, p, r) == brute(p, r)


def test_hot_key_is_salted_and_whole(spark):
    p, r = random_case(9, hot=True)
    assert run(spark, p, r) == brute(p, r)


def test_empty_tables(spark):
    p, r = random_case(1)
    assert run(spark, p, []) == set()
    assert {x[4] for x in run(spark, [], r)} == {"missing"}


def test_probe_states():
    k = np.array([5, 5, 5, 8]), np.array([10, 20, 30, 5]), np.array([1, 2, 2, 1]), np.array([1, 0, 1, 0])
    known = O.ParentRange(*k)
    keys, ts = np.array([5, 5, 5, 5, 8, 9, 1]), np.array([9, 10, 25, 30, 6, 1, 1])
    assert known.probe(keys, ts).tolist() == [O.LATE, 0, O.DELETED, 0, O.DELETED, O.MISSING, O.MISSING]
