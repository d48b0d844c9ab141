"""Quantiles of groups against sorted lists, whatever may be gathered."""

import random

import numpy as np
import pytest

from glosswork.operators import order


@pytest.mark.parametrize("gathered", [1, 7, 10_000])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_quantiles(spark, gathered, kind):
    rng = random.Random(gathered)
    number = {"long": lambda: rng.choice([rng.randint(0, 5), rng.randint(-(2**62), 2**62)]), "double": lambda: rng.choice([0.0, rng.gauss(0, 1), rng.gauss(0, 1) * 1e300, rng.gauss(0, 1) * 1e-300])}[kind]
    groups = {"a": [number() for _ in range(200)], "b": [number()], None: [number() for _ in range(31)], "same": [number()] * 50, "none": []}
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("a", None, "x"), ("none", None, "x")]
    if kind == "double":
        rows += [("a", float("nan"), "x"), ("none", float("-inf"), "x")]
    df = spark.createDataFrame(rows, f"k string, x {kind}, g string").repartition(3)
    shares = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p100": 1.0}
    got = {r["k"]: r for r in order.quantiles(df, "k", "x", shares, gathered=gathered).collect()}
    assert set(got) == {"a", "b", None, "same"}
    for g, r in got.items():
        own = sorted(groups[g])
        assert r["n"] == len(own) and [r[n] for n in shares] == [own[round(f * (len(own) - 1))] for f in shares.values()]


def test_means_of_neighbours(spark):
    rng = random.Random(1)
    rows = [(g, rng.gauss(0, 5)) for g in "abc" for _ in range({"a": 40, "b": 41, "c": 1}[g])]
    got = order.quantiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", {"m": 0.5, "q": 0.3}, between=True, gathered=5).collect()
    for r in got:
        own = [x for g, x in rows if g == r["k"]]
        assert r["m"] == pytest.approx(np.median(own)) and r["q"] == pytest.approx(np.quantile(own, 0.3))
    assert len(got) == 3
