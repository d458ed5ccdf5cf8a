from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import isax
from shelfcast.operators import clusters as C, embed as E, features as X, learn as L, neural as N
from tests.conftest import month


@pytest.fixture(scope="module")
def blobs(spark):
    """Four separated centres, planted."""
    centre = F.col("id") % 4
    noise = lambda i: (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 - 0.5) * 0.2
    return spark.range(200).select(
        "id", centre.cast("int").alias("truth"), (centre % 2 * 5 + noise(1)).alias("x"), (F.floor(centre / 2) * 5 + noise(2)).alias("y")
    )


def test_clusterings_find_planted_centres(blobs):
    for fit in (C.kmeans, C.bisecting):
        out, _ = fit(blobs, ["id"], ["x", "y"], 4, seed=3)
        rand = C.agreement(out, "truth", "cluster").first().rand_index
        assert rand == 1.0, fit
    two = blobs.withColumn("truth", F.col("truth") % 2)
    out, _ = C.gmm(two, ["id"], ["x"], 2)
    assert C.agreement(out, "truth", "cluster").first().rand_index == 1.0
    assert out.agg(F.max(F.abs(F.col("p_0") + F.col("p_1") - 1))).first()[0] < 1e-9
    assert C.choose_k(blobs, ["id"], ["x", "y"], [2, 4, 6]).where("rank = 1").first().k == 4


def test_fits_repeat(blobs):
    a, b = (sorted(map(tuple, C.kmeans(blobs, ["id"], ["x", "y"], 3, seed=5)[0].collect())) for _ in range(2))
    assert a == b


def test_assign_and_profile(spark, blobs):
    cents = C.centroids_of(blobs, "truth", ["x", "y"])
    out = C.assign(blobs, cents, "truth", ["x", "y"])
    assert out.where("cluster <> truth").count() == 0 and out.agg(F.max("distance")).first()[0] < 0.2
    prof = {(r.cluster, r.feature): r for r in C.cluster_profile(out, "cluster", ["x", "y"]).collect()}
    v = [r.x for r in out.where("cluster = 1").collect()]
    assert prof[1, "x"].size == 50 and prof[1, "x"].median == pytest.approx(np.median(v)) and prof[1, "x"].q1 == pytest.approx(np.quantile(v, 0.25))
    z = C.cluster_input(blobs.withColumn("flat", F.lit(3.0)), ["x", "flat"], ["id"])
    assert z.agg(F.max("flat"), F.round(F.avg("x"), 6), F.round(F.stddev_pop("x"), 6)).first()[:] == (0.0, 0.0, 1.0)


def test_rand_index_is_symmetric_and_right(spark):
    rows = [("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 2)]
    df = spark.createDataFrame(rows, "p string, q int")
    # pairs together in both: 1, apart in both: 5, of 10
    assert C.agreement(df, "p", "q").first().rand_index == pytest.approx(0.6)
    assert C.agreement(df, "q", "p").first().rand_index == pytest.approx(0.6)


@pytest.fixture(scope="module")
def lines(spark):
    """Planted: series with a slope of their own, 40 months."""
    return spark.range(12 * 40).select(
        F.concat(F.lit("s"), (F.col("id") % 12).cast("string")).alias("s"),
        F.add_months(F.lit(month(0)), F.floor(F.col("id") / 12).cast("int")).alias("period"),
        (20 + F.col("id") % 12 + (1 + F.col("id") % 12 / 4) * F.floor(F.col("id") / 12)).cast("double").alias("qty"),
    )


def test_linear_model_recovers_lines(lines):
    sup = X.supervised(lines, ["s"], "month", ks=(1, 2), ns=(3,))
    cols = ["lag_1", "lag_2", "mean_3"]
    train, test = sup.where(F.col("period") < month(30)), sup.where(F.col("period") >= month(30))
    # heads of series are no lines: what came before them is unknown
    fc = L.predict(L.fit_linear(train.dropna(subset=cols), ["s"], cols), test, ["s"], "linear").join(test.select("s", "period", "label"), ["s", "period"])
    assert fc.count() == 120 and fc.agg(F.max(F.abs(F.col("yhat") - F.col("label")))).first()[0] < 0.01


def test_direct_and_recursive_on_lines(lines):
    fit = partial(L.fit_linear, reg=0.0)
    truth = {(r.s, r.period): r.qty for r in lines.collect()}
    for fn in (L.direct, L.recursive):
        rows = fn(lines, ["s"], "month", month(35), 3, fit, L=4).collect()
        assert sorted((r.s, r.h) for r in rows) == sorted((f"s{i}", h) for i in range(12) for h in (1, 2, 3))
        assert all(abs(r.yhat - truth[r.s, r.period]) < 0.3 for r in rows), fn.__name__
        assert all(r.period == month(35 + r.h) for r in rows)


def test_recursive_does_not_see_the_future(lines):
    changed = lines.withColumn("qty", F.when(F.col("period") > month(35), -1.0).otherwise(F.col("qty")))
    get = lambda p: sorted(map(tuple, L.recursive(p, ["s"], "month", month(35), 2, L.fit_linear, L=3).collect()))
    assert get(lines) == get(changed)


@pytest.fixture(scope="module")
def steps(spark):
    """Planted step function of two lags."""
    h = F.pmod(F.xxhash64("id"), F.lit(100))
    df = spark.range(600).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"), F.lit(month(0)).alias("period"),
        F.lit(month(0)).alias("origin"), F.lit(1).alias("h"),
        (h / 100).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100).alias("b"),
    )
    return df.withColumn("label", F.when((F.col("a") > 0.5) != (F.col("b") > 0.5), 10.0).otherwise(0.0))


def test_trees_beat_the_linear_model_on_steps(steps):
    error = {}
    for name, fit in {"linear": L.fit_linear, "gbt": L.fit_gbt, "forest": partial(L.fit_forest, depth=6)}.items():
        fc = L.predict(fit(steps, ["s"], ["a", "b"]), steps, ["s"], name).join(steps.select("s", "label"), "s")
        error[name] = fc.agg(F.avg(F.abs(F.col("yhat") - F.col("label")))).first()[0]
    assert error["gbt"] < 0.3 * error["linear"] and error["forest"] < 0.6 * error["linear"]
    top = L.importance(L.fit_gbt(steps.withColumn("junk", F.lit(1.0)), ["s"], ["a", "b", "junk"]), steps.sparkSession)
    assert top.orderBy("rank").collect()[-1].feature == "junk"


def test_glm_hurdle_and_residual_run_on_planted_demand(steps):
    df = steps.withColumn("label", F.round(F.exp(1 + F.col("a"))))
    out = L.predict(L.fit_glm(df, ["s"], ["a", "b"]), df, ["s"], "glm").join(df.select("s", "label"), "s")
    assert out.agg(F.avg(F.abs(F.col("yhat") - F.col("label")))).first()[0] < 0.5
    half = df.withColumn("label", F.when(F.col("b") > 0.5, 6.0).otherwise(0.0))
    h = L.hurdle(half, half, ["s"], ["a", "b"]).join(half.select("s", "label"), "s")
    assert h.agg(F.min("size"), F.max("size")).first()[:] == pytest.approx((6, 6))
    assert h.where("label = 0").agg(F.avg("p_sold")).first()[0] < 0.35
    r = L.residual(df.withColumn("base", F.col("label") - 2), df.withColumn("base", F.col("label") - 2), ["s"], ["a"], "base", L.fit_linear)
    assert r.join(df.select("s", "label"), "s").agg(F.max(F.abs(F.col("yhat") - F.col("label")))).first()[0] < 1e-6


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    net = N.Net(rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=2), 0.3, 1.0, 0.8)
    x, y = rng.integers(0, 9, (20, 3)).astype(float), rng.integers(0, 9, 20).astype(float)
    v, (_, grad) = net.flat(), net.loss_gradient(x, y)
    for i in range(len(v)):
        step = np.eye(len(v))[i] * 1e-5
        diff = (net.with_flat(v + step).loss_gradient(x, y)[0] - net.with_flat(v - step).loss_gradient(x, y)[0]) / 2e-5
        assert grad[i] == pytest.approx(diff, rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def alternating(spark):
    rows = [(f"s{k}", month(i), float((3 if (i + k) % 2 else 30) + k % 3)) for k in range(30) for i in range(24)]
    return L.windows(spark.createDataFrame(rows, "s string, period date, qty double"), ["s"], 4)


def test_networks_learn_an_alternating_pattern(alternating):
    base = alternating.agg(F.avg(F.abs(F.col("target") - 17.5))).first()[0]
    mae = lambda fc: fc.join(alternating.select("s", "period", "target"), ["s", "period"]).agg(
        F.avg(F.abs(F.col("yhat") - F.col("target")))
    ).first()[0]
    net = N.fit_nn(alternating, 4, hidden=4, epochs=40)
    assert mae(N.predict_nn(alternating, ["s"], net)) < 0.3 * base
    bins = N.fit_nn_bins(alternating, ["s"], 4, n_bins=4, hidden=(6,), epochs=40)
    assert mae(N.predict_nn_bins(alternating, ["s"], 4, bins)) < 0.3 * base


def test_windows_hold_only_the_past(make_panel):
    rows = L.windows(make_panel({"a": range(6)}), ["s"], 3, h=2).orderBy("period").collect()
    assert [(r.origin, r.period, r.lookback, r.target) for r in rows] == [
        (month(2), month(4), [0, 1, 2], 4.0), (month(3), month(5), [1, 2, 3], 5.0)
    ]


def test_bins_with_repeated_bounds(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,), (2.0,), (3.0,), (4.0,)], "target double")
    assert [(r.n, r.lo, r.hi) for r in N.bins(df, 4).orderBy("bin").collect()] == [(6, 0, 0), (1, 1, 1), (3, 2, 4)]
    assert N.bins(df, 4).agg(F.sum("n")).first()[0] == 10


def test_sax_and_pca(make_panel, spark):
    p = make_panel({"up": range(8), "down": range(8, 0, -1), "flat": [2] * 8})
    words = {r.s: r.word for r in E.sax(p, ["s"], 4, 4).collect()}
    assert words == {"up": "abcd", "down": "dcba", "flat": "cccc"}
    w = E.scaled_windows(L.windows(make_panel({"a": [i % 4 for i in range(20)]}), ["s"], 4), 4)
    out, model = E.embed_pca(w.select("s", "period", "emb"), ["s"], 3)
    # rotations of one cycle of 4: two components for its first frequency, one for its second
    assert sum(model.explainedVariance) == pytest.approx(1, abs=1e-6) and out.count() == 16


def test_twins_are_found_exactly_and_by_lsh(spark):
    rng = np.random.default_rng(4)
    m = np.repeat(rng.normal(size=(30, 8)), 2, axis=0) + rng.normal(size=(60, 8)) * 0.01
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, emb array<double>")
    twin = lambda i: i + 1 if i % 2 == 0 else i - 1
    assert all(r.neighbour_id == twin(r.query_id) for r in E.topk(df, df, 1).collect())
    pairs = {(r.query_id, r.neighbour_id) for r in E.lsh_pairs(df, df, d=0.3, bucket=2.0, tables=6).collect()}
    found = sum((i, twin(i)) in pairs for i in range(60))
    assert found >= 57 and all(i == j or j == twin(i) for i, j in pairs)


def test_thousands_of_centroids(spark):
    points = spark.range(500).select(F.col("id").alias("s"), (F.col("id") * 6.0 + 0.4).alias("x"))
    centroids = spark.range(3000).select(F.col("id").alias("c"), F.col("id").cast("double").alias("x"))
    got = C.assign(points, centroids, "c", ["x"]).collect()
    assert all(r.cluster == r.s * 6 and abs(r.distance - 0.4) < 1e-6 for r in got)


def test_lsh_takes_any_number_of_queries(spark):
    df = spark.range(11_000).select("id", F.array(F.col("id") * 10.0, F.lit(0.0)).alias("emb"))
    got = E.lsh_pairs(df, df, d=1.0, bucket=20.0)
    assert got.where("query_id = neighbour_id").count() == 11_000 == got.count()


def test_every_row_is_scored_and_learned_from(spark):
    rows = [(f"s{i}", month(0), month(0), 1, None if i % 4 == 0 else float(i), 0.0 if i % 4 == 0 else 2.0 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, period date, origin date, h int, a double, label double")
    for fit in (L.fit_linear, partial(L.fit_gbt, trees=3), L.fit_forest):
        model = fit(df, ["s"], ["a"])
        assert L.feature_names(model) == ["a", "a_missing"]
        fc = L.predict(model, df, ["s"], "m")
        assert fc.count() == 200 and fc.where("yhat IS NULL").count() == 0
    got = {r.s: r.yhat for r in L.predict(L.fit_linear(df, ["s"], ["a"]), df, ["s"], "m").collect()}
    assert got["s0"] == pytest.approx(0, abs=1e-6) and got["s3"] == pytest.approx(6, abs=1e-6)
    base = df.withColumn("base", F.col("a"))
    assert L.residual(base, base, ["s"], ["a"], "base", L.fit_linear).count() == 200
    assert L.hurdle(df, df, ["s"], ["a"]).count() == 200


def test_short_and_constant_series_get_a_forecast(make_panel):
    long = make_panel({"a": [5, 9, 1, 7, 2, 8] * 6, "flat": [3] * 36})
    short = make_panel({"short": range(36)}).where(F.col("period") >= F.lit(month(27)))
    p = long.unionByName(short)
    fits = {"direct": L.direct, "recursive": L.recursive}
    for name, fn in fits.items():
        got = fn(p, ["s"], "month", month(29), 2, partial(L.fit_linear, reg=0.1), L=6)
        assert sorted((r.s, r.h) for r in got.collect()) == [(s, h) for s in ("a", "flat", "short") for h in (1, 2)], name
    for fn in (E.analog_own, E.analog):
        got = {(r.s, r.h): r.yhat for r in fn(p, ["s"], "month", month(29), 2, 6, 2).collect()}
        assert sorted(got) == [(s, h) for s in ("a", "flat", "short") for h in (1, 2)]
        assert got["flat", 1] == pytest.approx(3) and got["short", 2] == pytest.approx(28)


def test_embeddings_know_the_past_only(make_panel):
    from shelfcast.plans.q_models import embedded_features

    p = make_panel({"a": range(30), "b": [4, 0, 0] * 10}).select(F.lit("x").alias("p_brand"), F.length("s").alias("c_nationkey"), "period", "qty", "s")
    p = p.withColumn("c_nationkey", F.when(F.col("s") == "a", 1).otherwise(2)).drop("s")
    changed = p.withColumn("qty", F.when(F.col("period") >= F.lit(month(24)), 500.0).otherwise(F.col("qty")))
    cols = ["c_nationkey", "period", *[f"emb_{i}" for i in range(1, 6)]]
    a, b = (sorted(map(tuple, embedded_features(x, month(24)).select(cols).collect())) for x in (p, changed))
    assert a == b and len(a) == 12


def test_lsh_returns_every_copy(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(99, [9.0, 9.0])], "id long, emb array<double>")
    got = E.lsh_pairs(df, df.where("id = 7"), d=0.5, bucket=2.0)
    assert sorted(r.neighbour_id for r in got.collect()) == list(range(40))


def test_analogs_repeat_a_planted_cycle(make_panel):
    cycle = [5, 9, 1, 7, 2, 8]
    p = make_panel({"a": cycle * 6, "b": [2 * v for v in cycle] * 6})
    for fn in (E.analog_own, E.analog):
        rows = fn(p, ["s"], "month", month(29), 3, 6, 2).collect()
        assert {(r.s, r.h): round(r.yhat, 6) for r in rows} == {
            (s, h): f * cycle[h - 1] for s, f in (("a", 1), ("b", 2)) for h in (1, 2, 3)
        }


def test_indexed_search_equals_all_pairs(spark):
    """Random, equal and zero vectors, queries in and out of the index, few and many neighbours, small blocks and leaves."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 12)), np.repeat(rng.normal(size=(3, 12)), 40, axis=0), np.zeros((5, 12))])
    x[400:520:2] += rng.normal(scale=1e-3, size=(60, 12))
    v = spark.createDataFrame([(f"v{i:03d}", row.tolist()) for i, row in enumerate(x)], "id string, emb array<double>")
    q = v.where("id < 'v020' OR id >= 'v400'").unionByName(
        spark.createDataFrame([(f"q{i}", row.tolist()) for i, row in enumerate(rng.normal(size=(10, 12)))], "id string, emb array<double>")
    )
    cols = ["query_id", "neighbour_id", "similarity", "rank"]
    for k in (1, 4, 30):
        want = sorted(map(tuple, E.topk(v, q, k).select(cols).collect()))
        got = isax.topk(v, q, k)
        assert sorted(map(tuple, got.select(cols).collect())) == want
    assert isax.topk(v, q.limit(0), 3).count() == 0 and isax.topk(v.limit(0), q, 3).count() == 0


def test_leaves_hold_every_row_once_and_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 12))
    x[:300] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = isax.leaves_of(x, 50)
    assert sorted(np.concatenate(parts).tolist()) == list(range(2000)) and max(map(len, parts)) <= 50
    lo, hi = (np.array([f(x[p], axis=0) for p in parts]) for f in (np.min, np.max))
    bound = isax.bounds(x[::20], lo, hi)
    for j, p in enumerate(parts):
        assert (bound[:, j] >= (x[::20] @ x[p].T).max(axis=1)).all()
    # like windows lie together: most leaves are ruled out for a query that has close neighbours
    walks = isax._unit(np.cumsum(rng.normal(size=(20_000, 12)), axis=1))
    walks = isax._unit(walks - walks.mean(axis=1, keepdims=True))
    parts = isax.leaves_of(walks)
    lo, hi = (np.array([f(walks[p], axis=0) for p in parts]) for f in (np.min, np.max))
    near = isax._unit(walks[::200] + rng.normal(scale=0.01, size=(100, 12)))
    assert (isax.bounds(near, lo, hi) < 0.99).mean() > 0.9


def test_indexed_analogs_equal_all_pairs(make_panel):
    rng = np.random.default_rng(5)
    p = make_panel({f"s{i}": rng.poisson(2, 48).tolist() for i in range(25)} | {"flat": [3] * 48, "zero": [0] * 48, "short": [1, 2, 3]})
    cols = ["s", "h", "period"]
    one, two = ({tuple(r[c] for c in cols): r.yhat for r in f(p, ["s"], "month", month(41), 3, 6, 4).collect()} for f in (E.analog, E.analog_indexed))
    assert one.keys() == two.keys() and len(one) == 28 * 3
    assert all(one[x] == pytest.approx(two[x]) for x in one)


def test_index_in_many_cells_equals_all_pairs(spark, monkeypatch):
    """Cells, blocks and turns as of a large table; of equal vectors only the first ids are held and compared."""
    monkeypatch.setattr(isax, "CELL_ROWS", 60)
    monkeypatch.setattr(isax, "BLOCK_ROWS", 40)
    monkeypatch.setattr(isax, "TURN_ROWS", 25)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.poisson(0.4, (500, 12)).astype(float), np.repeat(np.eye(12)[:2], 300, axis=0)])
    rows = [(f"v{i:04d}", (row - row.mean()).tolist()) for i, row in enumerate(x)]
    # ids may come twice
    v = spark.createDataFrame(rows + rows[::50], "id string, emb array<double>").repartition(5)
    cols = ["query_id", "neighbour_id", "similarity", "rank"]
    q = v.where("id < 'v0040' OR id >= 'v1080'").dropDuplicates(["id"])
    found = isax.topk(v, q, 3)
    want = E.topk(v, q, 3).select(cols).collect()
    assert sorted(map(tuple, found.select(cols).collect())) == sorted(map(tuple, want))
    index = isax.build(v, k=3)
    held = index.leaves.selectExpr("sum(size(ids)) AS n", "count(DISTINCT cell) AS cells").first()
    # of 1,122 rows
    assert held["n"] < 600 and held["cells"] > 3
    assert found.agg({"compared": "max"}).first()[0] < 600


def test_index_keeps_no_unit_vectors_and_leaves_no_tables_behind(make_panel, monkeypatch):
    """Every stored row and every table that is left: quantities are kept, z-scores and what a later step has read are not."""
    import os

    from shelfcast.functions import runtime

    stored = []

    def noted(df, *args, **kwargs):
        out = runtime.durable(df, *args, **kwargs)
        stored.append(out)
        return out

    monkeypatch.setattr(E, "durable", noted)
    monkeypatch.setattr(isax, "durable", noted)
    rng = np.random.default_rng(12)
    p = make_panel({f"s{i}": rng.poisson(2, 48).tolist() for i in range(8)})
    fc = E.analog_indexed(p, ["s"], "month", month(41), 3, 6, 4)
    assert not any({"emb", "unit", "units"} & set(df.columns) for df in stored)
    left = [df for df in stored if os.path.exists(df._stored_at.removeprefix("file://"))]
    # the windows and what the two searches found
    assert [df.columns[0] for df in left] == ["s", "query_id", "query_id"] and fc.count() == 8 * 3


def test_unit_windows_equal_scaled_windows(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.poisson(0.6, (200, 12)), rng.normal(size=(200, 12)), np.ones((1, 12))]).astype(float)
    rows = E.scaled_windows(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, lookback array<double>"), 12).orderBy("i").collect()
    assert (E._unit_windows(x) == isax._unit(np.array([r.emb for r in rows]))).all()


def test_cuts_part_rows_evenly_and_reach_every_row():
    rng = np.random.default_rng(9)
    x = isax._unit(rng.poisson(0.5, (20_000, 12)) - 0.5)
    cells = isax.cuts_of(x[::10], 50).cell(x)
    n = np.bincount(cells)
    assert len(n[n > 0]) > 40 and n.max() < 3 * len(x) / 50
    assert (isax.cuts_of(np.ones((9, 3)), 4).cell(np.ones((2, 3))) == 0).all()


def test_own_analogs_equal_plain_loops(make_panel):
    """Windows are worked out in batches: short, constant and tied histories, and lengths side by side."""
    rng = np.random.default_rng(11)
    L, H, k, until = 6, 2, 3, 40
    series = {f"s{i}": rng.poisson(0.6, 44).tolist() for i in range(30)} | {"flat": [2] * 44, "still": [1, 5] * 17 + [3] * 10}
    p = make_panel(series).where((F.col("s") != "s7") | (F.col("period") > F.lit(month(30))))

    def plain(y):
        now = y[-L:]
        m, d = np.mean(now), np.std(now)
        past = [(round(float(np.dot((now - m) / d, (w - w.mean()) / w.std())) / L, 9), i) for i in range(len(y) - L - H + 1)
                for w in [y[i : i + L]] if d > 1e-9 and w.std() > 1e-9] if len(y) >= 2 * L + H else []
        top = [i for _, i in sorted(past, reverse=True)[:k]]
        return [m + d * np.mean([(y[i + L + h] - y[i : i + L].mean()) / y[i : i + L].std() for i in top]) if top else m for h in range(H)]

    fc = E.analog_own(p, ["s"], "month", month(until), H, L, k)
    got = {(r.s, r.h): r.yhat for r in fc.collect()}
    assert len(got) == 32 * H
    for s, values in series.items():
        y = np.array(values[31 if s == "s7" else 0 : until + 1], float)
        assert [got[s, h + 1] for h in range(H)] == pytest.approx(plain(y)), s
    # no nested lambdas over all windows of a row
    assert "MapInArrow" in fc._jdf.queryExecution().toString()
