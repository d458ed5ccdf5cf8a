"""Seasons from the periodogram, and a robust decomposition with several of them.

The periodogram tells which share of a series' variance each frequency holds; Fisher's test tells
which share is too large for noise. The decomposition alternates smooth trend and seasonal figures
(Cleveland et al. 1990; with several seasons Bandara, Hyndman & Bergmeir 2021), all by local
regression, and gives values far off the fit less weight, so that an outlier stays in the remainder.
Series of one length are smoothed together, as products of matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import shift_period
from ..functions.rows import map_series, series_rows


def power_shares(y: np.ndarray) -> np.ndarray:
    """Share of the variance at 1, 2 … cycles per series; zeros for a constant one."""
    size = y.shape[1]
    if size < 2:
        return np.zeros((len(y), 0))
    power = np.abs(np.fft.rfft(y - y.mean(axis=1, keepdims=True), axis=1)[:, 1:]) ** 2
    if size % 2 == 0:
        power[:, -1] /= 2  # the highest frequency has no counterpart
    total = power.sum(axis=1, keepdims=True)
    return np.divide(power, total, out=np.zeros_like(power), where=total > 1e-9 * size)


def periodogram(panel: DataFrame, keys: list[str]) -> DataFrame:
    """keys…, cycles (1 to half the length), season (periods per cycle) and share of the variance."""
    rows = map_series(series_rows(panel, keys), "_share array<double>", lambda y: {"_share": power_shares(y).tolist()})
    return rows.select(*keys, F.size("_y").alias("_n"), F.posexplode("_share").alias("_i", "share")).select(
        *keys, (F.col("_i") + 1).alias("cycles"), (F.col("_n") / (F.col("_i") + 1)).alias("season"), "share"
    )


def seasons(periods: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """The frequencies of a periodogram that hold more than noise would, largest first (rank 1).

    Fisher's test: of m frequencies the largest share of noise exceeds 1 - (level / m)^(1 / (m - 1))
    with a chance of at most ``level``.
    """
    own = W.partitionBy(*keys)
    m = F.count("*").over(own)
    critical = F.when(m > 1, 1 - F.pow(F.lit(level) / m, 1 / (m - 1)))
    told = periods.withColumn("critical", critical).where(F.col("share") > F.col("critical"))
    return told.withColumn("rank", F.row_number().over(own.orderBy(F.desc(F.round("share", 9)), "cycles")))


def kernel(size: int, span: float) -> np.ndarray:
    """Tricube weights of all points for each point; ``span`` is the distance at which they end."""
    d = np.abs(np.subtract.outer(np.arange(size), np.arange(size))) / span
    return np.clip(1 - d**3, 0, None) ** 3


def loess(y: np.ndarray, weights: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Local lines through each row, with a weight per value; where they are not determined, local means."""
    t = np.arange(y.shape[1]) - (y.shape[1] - 1) / 2
    s0, s1, s2 = (np.maximum(weights, 1e-9) * t**p @ k.T for p in range(3))
    b0, b1 = (np.maximum(weights, 1e-9) * y * t**p @ k.T for p in range(2))
    det = s0 * s2 - s1 * s1
    line = det > 1e-9 * np.maximum(s0 * s2, 1e-300)
    slope = np.divide(s0 * b1 - s1 * b0, det, out=np.zeros_like(det), where=line)
    return np.where(line, (b0 - slope * s1) / s0 + slope * t, b0 / s0)


def season_figure(y: np.ndarray, weights: np.ndarray, period: int, span: float) -> np.ndarray:
    """The seasonal part of rows without trend: each position smoothed over the cycles, less its running mean over a cycle."""
    out = np.empty_like(y)
    for at in range(period):
        part = y[:, at::period]
        out[:, at::period] = loess(part, weights[:, at::period], kernel(part.shape[1], span))
    # what a whole cycle has in common belongs to the trend
    padded = np.hstack([out[:, :period], out, out[:, -period:]])
    sums = np.cumsum(np.hstack([np.zeros((len(y), 1)), padded]), axis=1)
    half = period // 2
    at = np.arange(y.shape[1]) + period - half
    mean = (sums[:, at + period] - sums[:, at]) / period
    if period % 2 == 0:
        mean = (mean + (sums[:, at + period + 1] - sums[:, at + 1]) / period) / 2
    return out - mean


def robust_parts(y: np.ndarray, periods: list[int], trend_span: float, season_span: float, rounds: int, inner: int = 3) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(trend, seasonal part of each period, weight of each value) of rows of one length."""
    k = kernel(y.shape[1], trend_span)
    weights, trend = np.ones_like(y), np.zeros_like(y)
    parts = [np.zeros_like(y) for _ in periods]
    for r in range(rounds):
        for _ in range(inner):
            for i, p in enumerate(periods):
                others = sum((x for j, x in enumerate(parts) if j != i), np.zeros_like(y))
                parts[i] = season_figure(y - trend - others, weights, p, season_span)
            trend = loess(y - sum(parts, np.zeros_like(y)), weights, k)
        if r + 1 < rounds:
            off = np.abs(y - trend - sum(parts, np.zeros_like(y)))
            limit = 6 * np.median(off, axis=1, keepdims=True)
            u = np.divide(off, limit, out=np.zeros_like(off), where=limit > 1e-12)
            weights = np.clip(1 - u * u, 0, None) ** 2
    return trend, parts, weights


def decompose_robust(
    panel: DataFrame, keys: list[str], freq: str, periods: list[int], trend_span: float | None = None, season_span: float = 1e6, rounds: int = 4
) -> DataFrame:
    """keys…, period, qty, trend, seasonal_<p> for each of ``periods``, remainder and weight (0: taken for an outlier).

    ``trend_span`` is the reach of the trend to both sides, by default one and a half of the longest
    season; ``season_span`` that of a seasonal figure over cycles, by default so long that it repeats.
    Seasons longer than half a series are left out of it (their part is 0). ``panel`` is dense.
    """
    span = trend_span or 1.5 * max(periods) + 1
    names = ["trend", *[f"seasonal_{p}" for p in periods], "weight"]

    def compute(y: np.ndarray) -> dict[str, list]:
        y = np.nan_to_num(y)
        some = [p for p in sorted(periods) if 2 * p <= y.shape[1]]
        if not y.shape[1]:
            return {f"_{n}": [[]] * len(y) for n in names}
        trend, parts, weights = robust_parts(y, some, span, season_span, rounds)
        found = {f"seasonal_{p}": part for p, part in zip(some, parts)}
        return {f"_{n}": {"trend": trend, "weight": weights, **found}.get(n, np.zeros_like(y)).tolist() for n in names}

    rows = map_series(series_rows(panel, keys), ", ".join(f"_{n} array<double>" for n in names), compute)
    each = rows.select(*keys, "_first", F.posexplode(F.arrays_zip("_y", *[f"_{n}" for n in names])).alias("_i", "_v"))
    value = lambda n: F.col(f"_v._{n}")
    seasonal = sum((value(f"seasonal_{p}") for p in periods), F.lit(0.0))
    return each.select(
        *keys, shift_period("_first", F.col("_i"), freq).alias("period"), value("y").alias("qty"), *[value(n).alias(n) for n in names],
        (value("y") - value("trend") - seasonal).alias("remainder"),
    )
