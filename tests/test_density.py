import numpy as np

from shelfcast.operators import density as D


def brute(x, eps, least):
    """(kind, set of its core cluster) per point, by all pairs."""
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = far <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        after = np.array([min([label[i], *label[near[i] & core]]) if core[i] else len(x) for i in range(len(x))])
        if (after == label).all():
            break
        label = after
    kind = np.where(core, "core", np.where((near & core[None]).any(axis=1), "border", "noise"))
    for i in np.flatnonzero(kind == "border"):
        ok = np.flatnonzero(near[i] & core)
        label[i] = label[ok[np.argmin(far[i, ok])]]
    return kind.tolist(), label.tolist()


def rings(rng):
    angle = rng.uniform(0, 2 * np.pi, 500)
    ring = lambda r, n: np.stack([r * np.cos(angle[:n]), r * np.sin(angle[:n])], axis=1) + rng.normal(0, 0.05, (n, 2))
    return np.concatenate([ring(1, 200), ring(3, 400), rng.uniform(-5, 5, (40, 2)), np.zeros((30, 2)) + [6, 6]])


def test_planted_rings_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    x = rings(np.random.default_rng(1))
    df = spark.createDataFrame([(f"p{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, u double, v double").repartition(5)
    got = {r.k: r for r in D.density_clusters(df, ["k"], ["u", "v"], 0.35, 6).collect()}
    kind, label = brute(x, 0.35, 6)
    rows = [got[f"p{i:04d}"] for i in range(len(x))]
    assert [r.kind for r in rows] == kind
    for i, r in enumerate(rows):
        assert (r.cluster is None) == (kind[i] == "noise")
        if r.cluster is not None:
            assert r.cluster == f'{{"k":"p{label[i]:04d}"}}'
    assert len({r.cluster for r in rows if r.kind == "core"}) >= 3


def test_three_columns(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (80, 3)) for c in (0, 3)] + [rng.uniform(-4, 8, (40, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "k long, a double, b double, c double")
    got = {r.k: r.kind for r in D.density_clusters(df, ["k"], ["a", "b", "c"], 0.6, 5).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, 0.6, 5)[0]


def test_odd_rows(spark):
    rows = [("a", 1.0, 1.0)] * 3 + [("b", None, 1.0), ("c", float("nan"), 0.0), (None, 1.0, 1.0), ("far", 90.0, 90.0)]
    df = spark.createDataFrame(rows, "k string, u double, v double")
    got = sorted((str(r.k), r.kind) for r in D.density_clusters(df, ["k"], ["u", "v"], 0.5, 4).collect())
    assert got == [("None", "core"), ("a", "core"), ("a", "core"), ("a", "core"), ("b", "noise"), ("c", "noise"), ("far", "noise")]
    assert D.density_clusters(df.limit(0), ["k"], ["u", "v"], 0.5, 4).count() == 0
