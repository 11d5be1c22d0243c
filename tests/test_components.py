"""Components finish in few levels whatever the shape of the links."""

import math
import random

import pytest

from amphora.operators import components


def count_levels(monkeypatch):
    levels, plain = [], components.contract
    monkeypatch.setattr(components, "contract", lambda links, level: levels.append(level) or plain(links, level))
    return levels


def test_ascending_chain(spark, monkeypatch):
    levels, n, bound = count_levels(monkeypatch), 100_000, 4_000
    out = components.component_labels(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"), bound)
    assert out.selectExpr("count(*)", "max(label)").first()[:] == (n, 0)
    assert 0 < len(levels) <= 2 * math.log2(n)


@pytest.mark.parametrize("kind", ["hub", "random", "names"])
def test_against_brute_force(spark, monkeypatch, kind):
    levels, rng = count_levels(monkeypatch), random.Random(4)
    pairs = [(500, i) for i in range(600)] if kind == "hub" else [(rng.randrange(900), rng.randrange(900)) for _ in range(420)]
    if kind == "names":
        pairs = [(f"n{a:04d}", f"n{b:04d}") for a, b in pairs]
    want = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(want[a], want[b])
            if (want[a], want[b]) != (low, low):
                want[a] = want[b] = low
                changed = True
    df = spark.createDataFrame(pairs, "a string, b string" if kind == "names" else "a bigint, b bigint")
    assert {r.id: r.label for r in components.component_labels(df, 40).collect()} == want and levels
    assert {r.id: r.label for r in components.component_labels(df).collect()} == want
