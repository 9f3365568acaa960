import random

from lanternway.llm import mixing as M
from lanternway.runtime import Scratch

SIZED = "doc_id long, source string, n_tokens long, weight double, uses int"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, total=None, seed=17):
    sized = Scratch(spark, "t").keep(spark.createDataFrame(docs, SIZED).drop("uses"))
    chosen, shares = M.mix(sized, spark.createDataFrame(targets, TARGETS), total, seed)
    return {r.doc_id: r for r in chosen.collect()}, {r.source: r for r in shares.collect()}


def docs_of(seed, n=3000):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None, "x"]), rng.choice([0, None and 1, rng.randrange(1, 200)]) or 0, rng.choice([None, 0.1, 1.0]), 9) for i in range(n)]


def test_shares_and_repeats(spark):
    docs = docs_of(4)
    got, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.0, 1)])
    have = {s: sum(d[2] for d in docs if d[1] == s) for s in "abc"}
    total = min(have["a"] / 0.5, 2 * have["b"] / 0.3, 4 * have["c"] / 0.2)
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)):
        used = sum(r.n_tokens * r.uses for r in got.values() if r.source == s)
        assert abs(used - share * total) <= 200 and shares[s].used_tokens == used
        uses = {r.uses for r in got.values() if r.source == s}
        assert max(uses) <= most and max(uses) - min(uses) <= 1
        epochs = int(share * total // have[s])
        if epochs:  # complete epochs come first: every document is in
            assert all(d[0] in got and got[d[0]].uses >= epochs for d in docs if d[1] == s)
    assert "gone" not in shares and not {r.source for r in got.values()} - set("abc")


def test_fraction_is_the_prefix_of_smallest_keys(spark, monkeypatch):
    docs = [(i, "a", 10, 1.0 if i % 2 else 0.05, 0) for i in range(400)]
    a, _ = run(spark, docs, [("a", 1.0, 1)], total=1000)
    monkeypatch.setattr(M, "SLICES", 3)
    b, _ = run(spark, docs, [("a", 1.0, 1)], total=1000)
    assert set(a) == set(b) and len(a) == 100
    assert sum(i % 2 for i in a) > 85  # heavier documents are taken first


def test_small_source_is_capped_and_reported(spark):
    docs = [(1, "a", 100, 1.0, 0), (2, "b", 1000, 1.0, 0)]
    got, shares = run(spark, docs, [("a", 0.5, 3), ("b", 0.4, 1), ("none", 0.1, 2)], total=2000)
    assert got[1].uses == 3 and shares["a"].short_tokens == 700 and shares["none"].used_tokens == 0 and shares["none"].short_tokens == 200
    assert abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-6


def test_empty(spark):
    got, shares = run(spark, [], [("a", 1.0, 1)])
    assert got == {} and shares["a"].used_tokens == 0
    assert run(spark, [(1, "a", 5, 1.0, 0)], [])[0] == {}


def test_border_by_narrowing_equals_sorting(spark, monkeypatch):
    """Weights as unequal as they come and a border one task could not sort at once: the same documents as one sorted prefix."""
    rng = random.Random(2)
    docs = [(i, "a", rng.randrange(1, 30), rng.choice([0.01, 0.012, 0.05, 1.0]) if i % 3 else None, 0) for i in range(900)]
    want, _ = run(spark, docs, [("a", 1.0, 1)], total=5000)
    monkeypatch.setattr(M, "SLICES", 4)
    monkeypatch.setattr(M, "BORDER", 3)
    got, shares = run(spark, docs, [("a", 1.0, 1)], total=5000)
    assert set(got) == set(want) and abs(shares["a"].used_tokens - 5000) <= 30
