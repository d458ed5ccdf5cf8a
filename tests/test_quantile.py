import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import quantile as Q


def model(levels=(0.1, 0.5, 0.9), L=3, seed=1):
    rng = np.random.default_rng(seed)
    return Q.QuantileModel(list(levels), rng.normal(size=(L + 1, len(levels))), 1.0, 0.7)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(2)
    m, x, y = model(), rng.gamma(2, 5, (40, 3)), rng.gamma(2, 5, 40)
    loss, g = m.loss_gradient(x, y)
    for i in np.ndindex(m.weights.shape):
        value = m.weights[i]
        both = []
        for e in (1e-6, -1e-6):
            m.weights[i] = value + e
            both.append(m.loss_gradient(x, y)[0])
        m.weights[i] = value
        assert (both[0] - both[1]) / 2e-6 == pytest.approx(g[i], abs=1e-3)
    off = m.scaled(y)[:, None] - m._stacked(m._raw(x))
    assert loss == pytest.approx(sum(max(q * o, (q - 1) * o) for row in off for q, o in zip(m.levels, row)))


def test_quantiles_never_cross():
    for seed in range(5):
        out = model((0.05, 0.2, 0.5, 0.8, 0.95), seed=seed).predict(np.random.default_rng(seed).gamma(1, 30, (200, 3)))
        assert (np.diff(out, axis=1) >= 0).all() and (out >= 0).all()


def test_planted_noise_is_covered(spark):
    """Noise that grows with the level of the window: quantiles follow it, in the whole and in each half."""
    rng = np.random.default_rng(3)
    level = rng.uniform(5, 80, 6000)
    y = level * np.exp(rng.normal(0, 0.4, 6000))
    rows = [([float(v)] * 4, float(t)) for v, t in zip(level, y)]
    df = spark.createDataFrame(rows, "lookback array<double>, target double").repartition(4)
    m = Q.fit_quantiles(df, [0.9, 0.1, 0.5], 4)
    out = m.predict(np.array([r[0] for r in rows]))
    for part in (level > 0, level < 40, level >= 40):
        assert (y[part, None] <= out[part]).mean(axis=0) == pytest.approx([0.1, 0.5, 0.9], abs=0.035)
    got = Q.predict_quantiles(df, m).orderBy("target").first()
    assert got.quantiles == pytest.approx(m.predict(np.array([got.lookback]))[0].tolist())
    assert Q.fit_quantiles(df.limit(0), [0.5], 4).weights.shape == (5, 1)
    with pytest.raises(ValueError):
        Q.fit_quantiles(df, [0.0], 4)


def test_conformal_widths(spark):
    """Intervals that are far too narrow in one group and too wide in the other are put right by what came before."""
    rng = np.random.default_rng(4)
    rows = []
    for t in range(8):
        for g, half in (("narrow", 1.0), ("wide", 30.0)):
            rows += [(g, t, 50 - half, 50 + half, float(v)) for v in rng.normal(50, 10, 400)]
    rows += [("narrow", 8, 49.0, 51.0, None), (None, 8, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "g string, t int, lo double, hi double, y double")
    got = Q.conformal(df, ["g"], "t", cover=0.9)
    inside = got.where("t >= 3").groupBy("g").agg(F.avg(F.col("y").between(F.col("lo_c"), F.col("hi_c")).cast("double")).alias("c"))
    assert {r.g: r.c for r in inside.collect() if r.c is not None} == pytest.approx({"narrow": 0.9, "wide": 0.9}, abs=0.03)
    assert got.count() == len(rows) and {r["shift"] for r in got.where("t = 0").collect()} == {0.0}
    # the shift by hand, from the three origins before
    past = sorted(max(lo - y, y - hi) for g, t, lo, hi, y in rows if g == "narrow" and t in (5, 6, 7))
    assert got.where("t = 8 AND g = 'narrow'").first()["shift"] == pytest.approx(np.quantile(past, 0.9))
    assert got.where("g IS NULL").first()["shift"] == 0 and Q.conformal(df.limit(0), ["g"], "t").count() == 0
