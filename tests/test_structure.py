import itertools

import numpy as np
import pytest

from shelfcast.operators import shifts as G, spectrum as P
from tests.conftest import month


def all_segmentations(y, penalty, least):
    """The least cost over every way to cut the series."""
    n, best = len(y), None
    for r in range(n // least):
        for cuts in itertools.combinations(range(least, n), r):
            ends = [0, *cuts, n]
            if all(b - a >= least for a, b in zip(ends, ends[1:])):
                cost = sum(((y[a:b] - y[a:b].mean()) ** 2).sum() + penalty for a, b in zip(ends, ends[1:]))
                if best is None or cost < best[0] - 1e-9:
                    best = cost, ends[1:]
    return best


@pytest.mark.parametrize("least", [1, 2, 3])
def test_segmentation_is_the_best_of_all(least):
    rng = np.random.default_rng(least)
    y = rng.integers(0, 4, (30, 13)) + np.where(np.arange(13) >= rng.integers(3, 10, (30, 1)), 5.0, 0.0)
    penalty = rng.uniform(0, 20, 30)
    for row, p, ends in zip(y, penalty, G.stretches(G.last_changes(y, penalty, least)[0], 13)):
        cost = sum(((row[a:b] - row[a:b].mean()) ** 2).sum() + p for a, b in zip([0, *ends], ends))
        assert cost == pytest.approx(all_segmentations(row, p, least)[0])


def test_dropping_changes_loses_nothing_and_saves_work():
    rng = np.random.default_rng(7)
    level = np.repeat(rng.normal(0, 50, (4, 20)), 25, axis=1)
    for y in (level + rng.normal(size=level.shape), rng.poisson(2, (50, 90)).astype(float)):
        penalty = 2 * G.noise_variance(y) * np.log(y.shape[1])
        (a, seen), (b, every) = (G.last_changes(y, penalty, 3, prune) for prune in (True, False))
        assert G.stretches(a, y.shape[1]) == G.stretches(b, y.shape[1])
        assert seen <= every
    one = (level + rng.normal(size=level.shape))[:1]
    penalty = 2 * G.noise_variance(one) * np.log(one.shape[1])
    assert G.last_changes(one, penalty, 3)[1] < 0.3 * G.last_changes(one, penalty, 3, False)[1]


def test_planted_shifts_and_short_series(make_panel):
    p = make_panel({"up": [5, 6, 5, 6] * 3 + [20, 21] * 6, "flat": [3] * 24, "zero": [0] * 24, "short": [1, 9], "one": [4], "spike": [2] * 11 + [40] + [2] * 12})
    got = {}
    for r in G.level_shifts(p, ["s"], "month").orderBy("s", "segment").collect():
        got.setdefault(r.s, []).append((r.start, r.end, r.n, r.level, r["shift"]))
    assert got["up"] == [(month(0), month(11), 12, 5.5, None), (month(12), month(23), 12, 20.5, 15.0)]
    assert got["short"] == [(month(0), month(1), 2, 5.0, None)] and len(got["one"]) == 1
    assert all(len(got[s]) == 1 for s in ("flat", "zero", "spike"))
    assert G.level_shifts(p.limit(0), ["s"], "month").count() == 0


def test_periodogram_finds_two_planted_seasons(make_panel):
    t = np.arange(96)
    rng = np.random.default_rng(2)
    y = 50 + 8 * np.sin(2 * np.pi * t / 12) + 5 * np.cos(2 * np.pi * t / 8) + rng.normal(size=96)
    p = make_panel({"two": y.tolist(), "noise": rng.normal(size=96).tolist(), "flat": [2] * 96, "one": [3], "odd": [1, 5, 2]})
    shares = P.periodogram(p, ["s"])
    total = {r.s: r.t for r in shares.groupBy("s").agg({"share": "sum"}).withColumnRenamed("sum(share)", "t").collect()}
    assert total["two"] == pytest.approx(1) and total["noise"] == pytest.approx(1) and total["flat"] == 0 and "one" not in total
    found = P.seasons(shares, ["s"]).orderBy("s", "rank").collect()
    assert [(r.s, r.season) for r in found] == [("two", 12.0), ("two", 8.0)]


def test_robust_decomposition_of_two_seasons_and_an_outlier(make_panel):
    t = np.arange(120)
    trend, a, b = 20 + 0.1 * t, 6 * np.sin(2 * np.pi * t / 4), 9 * np.cos(2 * np.pi * t / 12)
    clean = trend + a + b + np.random.default_rng(3).normal(0, 0.3, 120)
    spoiled = clean.copy()
    spoiled[[37, 80]] += [60, -45]
    p = make_panel({"clean": clean.tolist(), "spoiled": spoiled.tolist(), "short": [1, 2, 3], "flat": [5] * 30})
    rows = P.decompose_robust(p, ["s"], "month", [4, 12]).orderBy("s", "period").collect()
    assert len(rows) == 273
    for s in ("clean", "spoiled"):
        own = [r for r in rows if r.s == s]
        for r in own:
            assert r.qty == pytest.approx(r.trend + r.seasonal_4 + r.seasonal_12 + r.remainder)
        inner = slice(6, 114)
        assert np.abs(np.array([r.trend for r in own]) - trend)[inner].max() < 0.8
        # a season of 4 is one of 12 too: their sum is what can be told
        assert np.abs(np.array([r.seasonal_4 + r.seasonal_12 for r in own]) - a - b)[inner].max() < 1.0
    own = [r for r in rows if r.s == "spoiled"]
    assert own[37].weight == 0 and own[80].weight == 0 and own[37].remainder > 55 and own[80].remainder < -40
    assert all(abs(r.seasonal_12) < 1e-6 and abs(r.remainder) < 1e-6 and r.trend == pytest.approx(5) for r in rows if r.s == "flat")
    assert all(r.seasonal_12 == r.seasonal_4 == 0 for r in rows if r.s == "short")
    assert P.decompose_robust(p.limit(0), ["s"], "month", [4]).count() == 0
