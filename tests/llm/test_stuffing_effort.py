"""Repeats of a page are found with one sort where its characters are few, by ranks where they are many, with equal results."""

import random

import numpy as np
import pytest

from lanternway.llm import stuffing


def brute(text, depth, times):
    seen = {}
    for k in range(len(text) - depth + 1):
        if "#" not in text[k : k + depth]:
            seen.setdefault(text[k : k + depth], []).append(k)
    out = np.zeros(len(text), bool)
    for begins in seen.values():
        for k in begins if len(begins) >= times else ():
            out[k : k + depth] = True
    return out


def refuse(*_, **__):
    raise AssertionError("suffixes were ranked")


@pytest.mark.parametrize("kinds", [2, 60, 1400, 4000])
def test_repeats(monkeypatch, kinds):
    rng = random.Random(kinds)
    if kinds**stuffing.DEPTH < 2**63:
        monkeypatch.setattr(np, "argsort", refuse)
    for n in (0, 5, 6, 7, 400, 3 * kinds):
        some = [chr(0x3040 + k) for k in range(kinds)] + ["#"]
        text = "".join(rng.sample(some, len(some)) if n == 3 * kinds else rng.choices(some, k=n))
        text += text[:40] * 2 + "#" + text[10:30]
        assert (stuffing.repeated(text, stuffing.DEPTH, stuffing.TIMES) == brute(text, stuffing.DEPTH, stuffing.TIMES)).all()
        assert n < 400 or brute(text, stuffing.DEPTH, stuffing.TIMES).any() or kinds == 2


def test_bound_words_and_links():
    """Words always followed by the same word are bound unless a number follows; a point at the end makes no link."""
    assert stuffing.measure("buy the sofa now " * 12)[0] > 0
    assert [b[2] for b in stuffing.blocks_of("we met the 3 men and the 4 men, the 5 men, the 6 men, the 7 men, the 8 men")] == [True]
    assert stuffing.blocks_of("the end of it.")[0][1] == 0 and stuffing.blocks_of("see http://x.")[0][1] > 0
