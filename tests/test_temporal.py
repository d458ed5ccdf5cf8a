import numpy as np
import pytest

from shelfcast.functions.runtime import scratch_path
from shelfcast.operators import neural as N, temporal as T
from tests.conftest import month


def net(size=9, channels=3, seed=1):
    return T.Tcn.start(size, channels, 1.0, 0.8, seed)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(2)
    n, x, y = net(), rng.gamma(2, 3, (20, 9)), rng.gamma(2, 3, 20)
    _, g = n.loss_gradient(x, y)
    assert len(g) == len(n.flat)
    for i in range(len(n.flat)):
        both = []
        for e in (1e-5, -1e-5):
            flat = n.flat.copy()
            flat[i] += e
            both.append(T.replace(n, flat=flat).loss_gradient(x, y)[0])
        assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[i], rel=1e-4, abs=1e-5)


def test_layers_see_the_whole_window_and_nothing_ahead():
    n = net(24, 4)
    x = np.random.default_rng(3).gamma(2, 3, (1, 24))
    kept, z = n._forward(x)
    for at in range(24):
        other = x.copy()
        other[0, at] += 1
        k, z2 = n._forward(other)
        assert z2[0] != z[0]
        assert (k[-1][0][0, :at] == kept[-1][0][0, :at]).all()


def lagged(spark, lag, n=300, size=60):
    """Series whose next value is the one ``lag`` periods back: noise that comes again."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        first = rng.gamma(2, 10, lag)
        y = np.concatenate([first] * (size // lag + 1))[:size]
        rows += [(f"s{i}", month(t), float(v)) for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "s string, period date, qty double").repartition(4)


def test_a_long_lag_that_a_short_window_cannot_see(spark):
    p = lagged(spark, 16)
    before = p.where(f"period <= DATE '{month(47)}'")
    actual = {(r.s, r.period): r.qty for r in p.collect()}
    error = lambda fc: np.mean([(np.log1p(r.yhat) - np.log1p(actual[r.s, r.period])) ** 2 for r in fc.collect()])
    # both have the same rows and epochs
    wide = error(T.forecast_tcn(before, ["s"], "month", month(47), 1, 16, epochs=80))
    narrow = error(N.forecast_nn(before, ["s"], "month", month(47), 1, 12, epochs=80))
    assert wide < 0.6 * narrow


def test_training_goes_on_where_it_was_cut_off(spark):
    rng = np.random.default_rng(5)
    rows = [(x.tolist(), float(x[0] + 1)) for x in rng.gamma(2, 3, (200, 8))]
    df = spark.createDataFrame(rows, "lookback array<double>, target double").repartition(3)
    whole = T.fit_tcn(df, 8, channels=2, epochs=5)
    store = scratch_path(spark, "tcn")
    T.fit_tcn(df, 8, channels=2, epochs=2, store=store)
    resumed = T.fit_tcn(df, 8, channels=2, epochs=5, store=store)
    assert resumed.flat == pytest.approx(whole.flat, abs=1e-12)
    assert T.fit_tcn(df, 8, channels=2, epochs=5, store=store).flat == pytest.approx(whole.flat, abs=1e-12)


def test_short_series_and_none(spark, make_panel):
    p = make_panel({"a": [3, 4] * 12, "b": [1, 2, 3], "zero": [0] * 24})
    out = T.forecast_tcn(p, ["s"], "month", month(23), 2, 6, epochs=2).collect()
    assert {(r.s, r.h) for r in out} >= {("a", 1), ("a", 2), ("zero", 1)} and all(r.yhat >= 0 for r in out)
    assert T.forecast_tcn(p.limit(0), ["s"], "month", month(23), 2, 6, epochs=2).count() == 0
