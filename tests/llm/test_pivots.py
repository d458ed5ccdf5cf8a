import numpy as np
import pytest

from shelfcast.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own", "own") for i, v in rows], SCHEMA)


def brute(rows):
    """(links, component) per row by all cosines."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    unit = [np.array(v, "float32").astype(float) / np.linalg.norm(np.array(v, "float32").astype(float)) if k else None for (_, v), k in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]):
                near[i, j] = near[j, i] = unit[i] @ unit[j] >= 0.95
    label = np.arange(len(rows))
    while True:
        after = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (after == label).all():
            return near.sum(axis=1), label
        label = after


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for size in (1,) * 150 + (2,) * 60 + (5,) * 10 + (40, 130):
        centre = unit(rng.normal(size=64))
        for _ in range(size):
            rows.append(unit(centre + rng.uniform(0, 0.3) * unit(rng.normal(size=64))))
    rows += [rows[3], rows[3], rows[300], rows[300] * 2.5]
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in rows[j]]) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [16, 1024])
def test_links_and_components(spark, planted, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    got = pivots.link(frame(spark, planted)).toPandas().sort_values("vec_id", ignore_index=True)
    links, component = brute(planted)
    assert len(got) == len(planted)
    assert (got.n_links <= links).all(), "a pair counted twice or below the limit"
    assert got.n_links.sum() >= 0.98 * links.sum()
    assert (got.component_id == component).mean() > 0.99
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_recall_of_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    x = pivots.unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * pivots.unit(z)
    p = pivots.choose_pivots(x[:400], 64)
    top = lambda v: np.sort(np.argsort(-(v @ p.T), axis=1)[:, : pivots.PREFIX], axis=1)
    a, b = top(x), top(y)
    shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
    assert (shared >= pivots.SHARED).mean() > 0.97
    # sharing that many pivots and meeting in a list are the same
    meet = [len(set(r) & set(s)) > 0 for r, s in zip(pivots.list_keys(a, 64), pivots.list_keys(b, 64))]
    assert (np.array(meet) == (shared >= pivots.SHARED)).all()


@pytest.mark.parametrize("spread", [100.0, 1.0, 0.5])
@pytest.mark.parametrize("number", [128, 512, 2048])
def test_recall_on_planted_groups(number, spread, monkeypatch):
    """Groups of five near copies whose centres lie anywhere, or close to ten directions; all pairs at 0.95 by all cosines."""
    monkeypatch.setattr(pivots, "PIVOTS", number)
    rng = np.random.default_rng(1)
    tops = pivots.unit(rng.normal(size=(10, 64)))
    centres = pivots.unit(tops[rng.integers(0, 10, 400)] + spread * rng.normal(size=(400, 64)) / 8)
    c = np.repeat(centres, 5, axis=0)
    z = rng.normal(size=c.shape)
    z = pivots.unit(z - (z * c).sum(axis=1, keepdims=True) * c)
    cos = rng.uniform(0.965, 0.999, (len(c), 1))
    v = cos * c + np.sqrt(1 - cos**2) * z
    p = pivots.choose_pivots(v[rng.permutation(len(v))], 64, number)
    top = np.sort(np.argsort(-(v @ p.T), axis=1, kind="stable")[:, : pivots.PREFIX], axis=1)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.95, 1))
    shared = (top[i][:, :, None] == top[j][:, None, :]).sum(axis=(1, 2))
    assert len(i) > 3000 and (shared >= pivots.SHARED).mean() > 0.99


def test_edges(spark):
    e = [1.0] + [0.0] * 7
    rows = [
        (1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] * 8), (5, [None] + [1.0] * 7), (6, [float("inf")] * 8), (7, e), (8, e), (8, e), (None, e),
        (9, [1e-30] + [0.0] * 7), (10, [1e30] + [0.0] * 7), (11, [1.0, 0.0]), (12, [-1.0] + [0.0] * 7), (13, [1.0] + [0.0] * 6 + [0.01]), (None, None),
    ]
    got = pivots.link(frame(spark, rows)).toPandas()
    links, _ = brute(rows)
    want = {}
    for (i, _), n in zip(rows, links):
        want.setdefault(i, []).append(n)
    for i, n in want.items():
        mine = got[got.vec_id.isna()] if i is None else got[got.vec_id == i]
        assert sorted(mine.n_links) == sorted(n)
    of = got.dropna(subset="vec_id").groupby("vec_id").component_id.first()
    assert (of[[7, 8, 9, 10, 13]] == 7).all() and all(of[i] == i for i in (1, 2, 3, 4, 5, 6, 11, 12))
    assert not got[got.vec_id.isna()].kept.any()
    assert pivots.link(frame(spark, [])).count() == 0
    assert pivots.link(frame(spark, [(1, None)])).first().component_id == 1


def test_nothing_below_the_limit():
    nodes, n = np.arange(4), np.ones(4, "int64")
    v = np.array([[1, 0], [0.95, np.sqrt(1 - 0.95**2)], [0.9499, np.sqrt(1 - 0.9499**2)], [-1, 0]])
    prefix = np.tile(np.arange(pivots.PREFIX), (4, 1))
    key = int(pivots.list_keys(prefix[:1], 2)[0, 0])
    got = pivots.compare(key, nodes, n, np.zeros(4, "int64"), v, prefix, 0.9499999)
    assert dict(zip(*map(list, got[:2]))) == {0: 1, 1: 2, 2: 1}
