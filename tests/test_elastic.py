import numpy as np
import pytest

from shelfcast.operators import clusters as C, elastic as E



def plain(a, b, band):
    """Cheapest warping by the textbook table."""
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    return d[n, n]


@pytest.mark.parametrize("band", [0, 1, 3, 11])
def test_warping_and_its_bound(band):
    rng = np.random.default_rng(band)
    a, b = rng.normal(size=(2, 20, 12))
    got, kept = E.warp(a, b, band, moves=True)
    assert got == pytest.approx([plain(x, y, band) for x, y in zip(a, b)])
    low, high = E.envelopes(b, band)
    assert (E.lower_bounds(a, low, high).diagonal() <= got + 1e-9).all()
    # every point of a is laid somewhere, and every point of b gets one
    total, count = E.laid(a, kept, band)
    assert (count >= 1).all() and (count.sum(axis=1) >= 12).all()
    if band == 0:
        assert total == pytest.approx(a) and (count == 1).all()


def test_a_barycentre_is_no_worse_than_its_start(spark):
    rng = np.random.default_rng(5)
    x = E.standard(np.sin((np.arange(30)[None] + rng.integers(0, 4, (40, 1))) / 3) + rng.normal(0, 0.1, (40, 30)), 30)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, _x array<double>").repartition(3)
    centres, totals = x[:2], []
    for _ in range(4):
        centres, total = E.barycentres(rows, centres, 4, 30)
        totals.append(total)
    assert totals == sorted(totals, reverse=True)


def test_the_bound_changes_nothing_but_the_work():
    rng = np.random.default_rng(6)
    centres = E.standard(np.cumsum(rng.normal(size=(8, 40)), axis=1), 40)
    x = E.standard(centres[rng.integers(0, 8, 200)] + rng.normal(0, 0.2, (200, 40)), 40)
    which, distance, tried = E.nearest(x, centres, 3)
    every = np.array([E.warp(x, np.repeat(c[None], 200, axis=0), 3)[0] for c in centres])
    assert (which == every.argmin(axis=0)).all() and distance == pytest.approx(every.min(axis=0))
    assert tried.mean() < 3


def test_shifted_shapes_where_kmeans_fails(spark, make_panel):
    rng, t = np.random.default_rng(7), np.arange(48)
    peak = lambda at: np.exp(-(((t - at) / 1.5) ** 2))
    shapes = [lambda s: peak(15 + s) + peak(30 + s), lambda s: peak(15 + s) - peak(30 + s)]
    rows = {f"s{i:02d}_{i % 2}": shapes[i % 2](rng.integers(-4, 5)) + rng.normal(0, 0.02, 48) for i in range(40)}
    p = make_panel({s: v.tolist() for s, v in rows.items()})
    out, centres = E.elastic_clusters(p, ["s"], 2, band=9)
    got = {r.s: r.cluster for r in out.collect()}
    assert centres.shape == (2, 48) and len({(s[-1], c) for s, c in got.items()}) == 2 and len(set(got.values())) == 2
    z = spark.createDataFrame([(s, *map(float, E.standard(v[None], 48)[0])) for s, v in rows.items()], "s string, " + ", ".join(f"x{i} double" for i in range(48)))
    plain_clusters = {r.s: r.cluster for r in C.kmeans(z, ["s"], [f"x{i}" for i in range(48)], 2)[0].collect()}
    assert len({(s[-1], c) for s, c in plain_clusters.items()}) > 2


def test_odd_series(make_panel):
    p = make_panel({"flat": [3] * 24, "zero": [0] * 24, "short": [1, 5, 2], "one": [4], "a": list(range(24)), "b": list(range(24))})
    out, _ = E.elastic_clusters(p, ["s"], 4, band=2, tries=1)
    got = {r.s: r for r in out.collect()}
    assert len(got) == 6 and got["a"].cluster == got["b"].cluster and got["flat"].cluster == got["zero"].cluster == got["one"].cluster
    assert E.elastic_clusters(p.limit(0), ["s"], 2, band=2)[0].count() == 0
