"""Exponential smoothing with parameters fitted to each series, and the kind of model chosen by likelihood.

A model keeps a level and, by kind, a (damped) trend and a season; errors are additive and Gaussian, so
the most likely parameters are those of the least squared one-step error. All series of a batch are
fitted at once: a grid gives the start, then every series tries a step up and down in each of its
parameters and takes the best, with steps that halve once nothing helps. The kind is chosen by Akaike's
criterion with the correction for short series, over the same errors for all kinds.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_col, shift_period
from ..functions.rows import map_series, series_rows

#: The parameters of each kind, in the order in which they are fitted.
KINDS = {
    "level": ("alpha",),
    "trend": ("alpha", "beta"),
    "damped": ("alpha", "beta", "phi"),
    "season": ("alpha", "gamma"),
    "trend_season": ("alpha", "beta", "gamma"),
}
PARAMETERS = ("alpha", "beta", "phi", "gamma")
LOW, HIGH = {"phi": 0.8}, {"phi": 0.98}
START = (0.1, 0.3, 0.6, 0.9)
FIRST_STEP, LAST_STEP = 0.1, 1e-4
#: Rounds of moves at most: in a narrow valley of two parameters some series would creep on for thousands.
ROUNDS = 100


def _box(kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array([LOW.get(p, 0.01) for p in KINDS[kind]]), np.array([HIGH.get(p, 0.99) for p in KINDS[kind]])


def run(y: np.ndarray, kind: str, values: np.ndarray, season: int, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squared one-step errors from period ``skip`` on, last level, last trend, last season) for a row of values per series."""
    n, size = y.shape
    p = dict(zip(KINDS[kind], values.T))
    alpha, beta, phi, gamma = (p.get(c) for c in PARAMETERS)
    trended, seasonal = beta is not None, gamma is not None
    keep = 1.0 if phi is None else phi
    first = season if seasonal else 1
    level = y[:, :first].mean(axis=1)
    figure = y[:, :first] - level[:, None] if seasonal else np.zeros((n, 1))
    if not trended:
        slope = np.zeros(n)
    elif seasonal:
        slope = (y[:, season : 2 * season].mean(axis=1) - level) / season
    else:
        slope = y[:, 1] - y[:, 0]
    figure, errors = figure.copy(), np.zeros(n)
    for t in range(first, size):
        at = t % figure.shape[1]
        ahead = level + keep * slope if trended else level
        e = y[:, t] - ahead - figure[:, at] if seasonal else y[:, t] - ahead
        if t >= skip:
            errors += e * e
        level = ahead + alpha * e
        if trended:
            slope = keep * slope + alpha * beta * e
        if seasonal:
            figure[:, at] += (1 - alpha) * gamma * e
    return errors, level, slope, figure


def fit(y: np.ndarray, kind: str, season: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """(fitted parameters, squared error) of each row. Never worse than the best point of the starting grid."""
    low, high = _box(kind)
    grid = [np.array(v) for v in product(*[START if c != "phi" else (0.9,) for c in KINDS[kind]])]
    tried = np.array([run(y, kind, np.tile(v, (len(y), 1)), season, skip)[0] for v in grid])
    best = np.clip(np.array(grid)[tried.argmin(axis=0)], low, high)
    error = run(y, kind, best, season, skip)[0]
    step = np.full(len(y), FIRST_STEP)
    for _ in range(ROUNDS):
        going = np.flatnonzero(step > LAST_STEP)
        if not going.size:
            break
        sub, rows = best[going], y[going]
        moves = []
        for i in range(len(low)):
            for sign in (1, -1):
                v = sub.copy()
                v[:, i] = np.clip(v[:, i] + sign * step[going], low[i], high[i])
                moves.append((v, run(rows, kind, v, season, skip)[0]))
        errors = np.array([e for _, e in moves])
        pick = errors.argmin(axis=0)
        least = errors[pick, np.arange(len(going))]
        better = least < error[going] * (1 - 1e-7)
        best[going] = np.where(better[:, None], np.array([v for v, _ in moves])[pick, np.arange(len(going))], sub)
        error[going] = np.where(better, least, error[going])
        step[going] = np.where(better, step[going], step[going] / 2)
    return best, error


def criterion(error: np.ndarray, n: int, k: int) -> np.ndarray:
    """Akaike's criterion, corrected, of n errors and k parameters beside the variance; infinite where n is too small."""
    k += 1
    if n - k - 1 <= 0:
        return np.full(len(error), np.inf)
    return n * np.log(np.maximum(error / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def project(kind: str, values: np.ndarray, state: tuple, size: int, H: int) -> np.ndarray:
    """Forecasts 1 to H steps ahead of series of ``size`` values."""
    _, level, slope, figure = state
    p = dict(zip(KINDS[kind], values.T))
    keep = p.get("phi", np.ones(len(level)))
    out, reach = np.empty((len(level), H)), np.zeros(len(level))
    for h in range(H):
        reach = reach + keep ** (h + 1)
        out[:, h] = level + slope * reach + (figure[:, (size + h) % figure.shape[1]] if "gamma" in p else 0.0)
    return out


def fit_batch(y: np.ndarray, kinds: list[str], season: int, H: int) -> dict[str, list]:
    """Kind, parameters, criterion and forecasts of each row; rows too short for any kind take their last value."""
    n, size = y.shape
    fits = {}
    # all kinds are judged by the errors that the neediest of them has
    seasonal = any("gamma" in KINDS[k] for k in kinds) and size > 2 * season + 3
    skip = season if seasonal else 2
    for kind in kinds:
        if size > skip + 3 and ("gamma" not in KINDS[kind] or seasonal):
            values, error = fit(y, kind, season, skip)
            fits[kind] = values, error, criterion(error, size - skip, len(KINDS[kind])), project(kind, values, run(y, kind, values, season, skip), size, H)
    usable = [k for k in fits if np.isfinite(fits[k][2]).all()]
    if not usable:
        last = y[:, -1:] if size else np.zeros((n, 1))
        return {"kind": ["naive"] * n, **{c: [None] * n for c in (*PARAMETERS, "aicc", "mse")}, "yhat": np.repeat(last, H, axis=1).tolist()}
    pick = np.array([fits[k][2] for k in usable]).argmin(axis=0)
    out: dict[str, list] = {c: [None] * n for c in ("kind", *PARAMETERS, "aicc", "mse", "yhat")}
    for i, j in enumerate(pick):
        kind = usable[j]
        values, error, aicc, yhat = fits[kind]
        out["kind"][i], out["aicc"][i], out["mse"][i], out["yhat"][i] = kind, aicc[i], error[i] / (size - skip), yhat[i].tolist()
        for c, v in zip(KINDS[kind], values[i]):
            out[c][i] = v
    return out


def smoothing_models(panel: DataFrame, keys: list[str], origin, H: int, season: int = 12, kinds: list[str] | None = None) -> DataFrame:
    """keys…, kind, alpha, beta, phi, gamma (null where the kind has none), aicc, mse and yhat, an array of H forecasts.

    Fitted to what is known at ``origin``; ``panel`` is dense. A series of few periods is judged
    without a season, one of fewer than six keeps its last value (kind ``naive``).
    """
    known = series_rows(panel.where(F.col("period") <= as_col(origin)), keys)
    schema = "kind string, alpha double, beta double, phi double, gamma double, aicc double, mse double, yhat array<double>"
    chosen = list(kinds or KINDS)
    return map_series(known, schema, lambda y: fit_batch(np.nan_to_num(y), chosen, season, H)).drop("_first", "_y")


def forecast_fitted(panel: DataFrame, keys: list[str], freq: str, origin, H: int, season: int = 12, kinds: list[str] | None = None, name: str = "fitted") -> DataFrame:
    """A forecast frame (keys…, origin, model, h, period, yhat) of the chosen models."""
    at = as_col(origin)
    rows = smoothing_models(panel, keys, origin, H, season, kinds).select(*keys, F.posexplode("yhat").alias("_i", "yhat"))
    h = F.col("_i") + 1
    return rows.select(*keys, at.alias("origin"), F.lit(name).alias("model"), h.alias("h"), shift_period(at, h, freq).alias("period"), "yhat")


def against_grid(panel: DataFrame, keys: list[str], origin, grid: list[float], skip: int = 2) -> DataFrame:
    """keys…, alpha (best of ``grid``), log_mse (of that), not_worse: whether the fitted level model is at least as likely."""

    def compute(y: np.ndarray) -> dict[str, list]:
        n, size = y.shape
        if size <= skip + 3:
            return {"alpha": [None] * n, "log_mse": [None] * n, "not_worse": [True] * n}
        errors = np.array([run(y, "level", np.full((n, 1), a), 1, skip)[0] for a in grid])
        least = errors.min(axis=0)
        fitted = fit(y, "level", 1, skip)[1]
        first = (errors <= least * (1 + 1e-9)).argmax(axis=0)
        return {
            "alpha": [grid[i] for i in first], "log_mse": [float(np.log(e / (size - skip))) if e > 0 else None for e in least],
            "not_worse": (fitted <= least * (1 + 1e-6)).tolist(),
        }

    known = series_rows(panel.where(F.col("period") <= as_col(origin)), keys)
    return map_series(known, "alpha double, log_mse double, not_worse boolean", compute).drop("_first", "_y")
