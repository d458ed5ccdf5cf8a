import numpy as np
import pytest

from shelfcast.operators import smooth as S
from tests.conftest import month


def plain(y, alpha, beta=None, phi=1.0, gamma=None, m=1, skip=2):
    """One series, step by step, in error-correction form."""
    first = m if gamma is not None else 1
    level = np.mean(y[:first])
    season = [v - level for v in y[:first]] if gamma is not None else [0.0]
    slope = 0.0 if beta is None else (np.mean(y[m : 2 * m]) - level) / m if gamma is not None else y[1] - y[0]
    total = 0.0
    for t in range(first, len(y)):
        s = season[t % len(season)] if gamma is not None else 0.0
        e = y[t] - (level + phi * slope + s)
        total += e * e if t >= skip else 0
        level, slope = level + phi * slope + alpha * e, phi * slope + (alpha * beta * e if beta is not None else 0)
        if gamma is not None:
            season[t % len(season)] += (1 - alpha) * gamma * e
    return total, level, slope, season


@pytest.mark.parametrize("kind,args", [
    ("level", dict(alpha=0.3)), ("trend", dict(alpha=0.4, beta=0.2)), ("damped", dict(alpha=0.4, beta=0.2, phi=0.9)),
    ("season", dict(alpha=0.3, gamma=0.5, m=4)), ("trend_season", dict(alpha=0.3, beta=0.1, gamma=0.5, m=4)),
])
def test_errors_and_states_step_by_step(kind, args):
    y = np.random.default_rng(1).gamma(3, 5, (5, 30))
    values = np.tile([args[p] for p in S.KINDS[kind]], (5, 1))
    errors, level, slope, season = S.run(y, kind, values, args.get("m", 1), 4)
    for i in range(5):
        want = plain(y[i], **args, skip=4)
        assert errors[i] == pytest.approx(want[0]) and level[i] == pytest.approx(want[1]) and slope[i] == pytest.approx(want[2])
        assert season[i] == pytest.approx(want[3])
    ahead = S.project(kind, values, (errors, level, slope, season), 30, 6)
    phi = args.get("phi", 1.0)
    for h in range(6):
        s = season[:, (30 + h) % 4] if "gamma" in args else 0
        assert ahead[:, h] == pytest.approx(level + slope * sum(phi**j for j in range(1, h + 2)) + s)


def test_planted_parameters_are_found():
    rng = np.random.default_rng(2)
    y = np.empty((40, 1500))
    for i in range(40):
        level = 100.0
        for t in range(1500):
            e = rng.normal()
            y[i, t] = level + e
            level += 0.35 * e
    values, errors = S.fit(y, "level", 1, 2)
    assert abs(values.mean() - 0.35) < 0.02 and (np.abs(values[:, 0] - 0.35) < 0.12).all()
    assert all(errors[i] <= min(plain(y[i], a)[0] for a in np.arange(0.05, 1, 0.05)) * (1 + 1e-6) for i in range(40))


def test_the_planted_kind_is_chosen(make_panel):
    rng, t = np.random.default_rng(3), np.arange(84)
    rows = {f"flat{i}": 50 + rng.normal(0, 2, 84) for i in range(6)}
    rows |= {f"rise{i}": 20 + 3 * t + rng.normal(0, 2, 84) for i in range(6)}
    rows |= {f"wave{i}": 50 + 20 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 2, 84) for i in range(6)}
    rows |= {"short": [4, 5, 6], "none": [7], "zero": [0] * 84, "mid": [3, 4, 3, 5, 4, 3, 4, 5, 3, 4]}
    p = make_panel({s: list(v) for s, v in rows.items()})
    got = {r.s: r for r in S.smoothing_models(p, ["s"], month(83), 3).collect()}
    assert len(got) == 22 and got["none"].kind == got["short"].kind == "naive" and got["short"].yhat == [6.0] * 3
    kinds = lambda name: [got[f"{name}{i}"].kind for i in range(6)]
    assert all("season" not in k for k in kinds("flat")) and kinds("flat").count("level") >= 4
    assert all(k in ("trend", "damped") for k in kinds("rise")) and all("season" in k for k in kinds("wave"))
    assert got["zero"].yhat == pytest.approx([0.0] * 3) and "season" not in got["mid"].kind
    fc = {(r.s, r.h): r.yhat for r in S.forecast_fitted(p, ["s"], "month", month(83), 3).collect()}
    assert len(fc) == 66
    for i in range(6):
        for h in (1, 2, 3):
            assert fc[f"rise{i}", h] == pytest.approx(20 + 3 * (83 + h), abs=12)
            assert fc[f"wave{i}", h] == pytest.approx(50 + 20 * np.sin(2 * np.pi * (83 + h) / 12), abs=8)
    assert S.forecast_fitted(p.limit(0), ["s"], "month", month(83), 3).count() == 0
