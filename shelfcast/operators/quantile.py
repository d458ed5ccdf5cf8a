"""Quantile forecasts trained by pinball loss, and intervals that keep their promise.

One model gives all quantiles of a window's next demand: the lowest is a linear function of the scaled
window, and each further one adds a positive step to the one below, so quantiles cannot cross. Demand
is scaled by a monotone function, under which quantiles stay quantiles. Training is by full batches:
every task adds up the subgradient of its rows, Spark adds the sums, and one vector of the model's size
reaches the driver per epoch.

Trained quantiles may still be too narrow for what comes. Conformal intervals (Romano, Patterson &
Candès 2019) widen or narrow them by how far past targets lay outside, in groups, before each origin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ranks import exact_quantiles
from ..functions.runtime import durable


@dataclass
class QuantileModel:
    levels: list[float]  # ascending
    weights: np.ndarray  # L + 1 rows (the last one constant), a column per level
    mean: float
    sd: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.log1p(np.maximum(x, 0)) - self.mean) / self.sd

    def _raw(self, x: np.ndarray) -> np.ndarray:
        s = self.scaled(x)
        return s @ self.weights[:-1] + self.weights[-1]

    @staticmethod
    def _stacked(raw: np.ndarray) -> np.ndarray:
        steps = np.logaddexp(0, raw[:, 1:])
        return np.cumsum(np.hstack([raw[:, :1], steps]), axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Rows x levels, in units of demand."""
        return np.maximum(np.expm1(self._stacked(self._raw(x)) * self.sd + self.mean), 0.0)

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed pinball loss in scaled demand, and a subgradient of it with the shape of ``weights``."""
        s, raw = self.scaled(x), self._raw(x)
        off = self.scaled(y)[:, None] - self._stacked(raw)
        levels = np.array(self.levels)
        loss = np.where(off >= 0, levels * off, (levels - 1) * off).sum()
        by_quantile = np.where(off >= 0, -levels, 1 - levels)
        # a step moves its own quantile and all above it
        back = np.cumsum(by_quantile[:, ::-1], axis=1)[:, ::-1].copy()
        back[:, 1:] /= 1 + np.exp(-raw[:, 1:])
        return float(loss), np.vstack([s.T @ back, back.sum(axis=0)])


def fit_quantiles(train: DataFrame, levels: list[float], L: int, epochs: int = 150, rate: float = 0.1) -> QuantileModel:
    """Learn from windows (``lookback`` of length L, ``target``). Steps shrink towards the end, as subgradients do not."""
    levels = sorted(levels)
    if not levels or levels[0] <= 0 or levels[-1] >= 1:
        raise ValueError("levels lie between 0 and 1")
    data = durable(train.select("lookback", F.col("target").cast("double")))
    st = data.select(F.explode("lookback").alias("x")).agg(F.avg(F.log1p("x")).alias("m"), F.stddev_pop(F.log1p("x")).alias("s")).first()
    model = QuantileModel(levels, np.zeros((L + 1, len(levels))), float(st["m"] or 0.0), float(st["s"] or 0.0) or 1.0)
    model.weights[-1, 0] = -1.0
    m1, m2 = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for t in range(1, epochs + 1):
        n, gradient = _added_up(data, model)
        if not n:
            break
        g = gradient / n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = rate * (1 - (t - 1) / epochs)
        model.weights = model.weights - step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return model


def _added_up(data: DataFrame, model: QuantileModel) -> tuple[float, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros_like(model.weights)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total = total + model.loss_gradient(x, b.column(1).to_numpy(zero_copy_only=False))[1]
                n += b.num_rows
        if n:
            values = np.concatenate([[n], total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

    # a fixed order of the terms makes the sum the same on every run
    ordered = F.aggregate(F.sort_array(F.collect_list("v")), F.lit(0.0), lambda a, b: a + b)
    got = data.mapInArrow(run, "i int, v double").groupBy("i").agg(ordered.alias("v")).collect()
    values = np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])
    return (float(values[0]), values[1:].reshape(model.weights.shape)) if len(values) else (0.0, model.weights)


def predict_quantiles(rows: DataFrame, model: QuantileModel, out: str = "quantiles") -> DataFrame:
    """``rows`` with an array of the model's quantiles, lowest first."""

    @F.pandas_udf("array<double>")
    def apply(look: pd.Series) -> pd.Series:
        if not len(look):
            return pd.Series([], dtype=object)
        return pd.Series(list(model.predict(np.stack(look.to_numpy()).astype(np.float64))))

    return rows.withColumn(out, apply("lookback"))


def conformal(rows: DataFrame, group: list[str], origin: str, cover: float = 0.8, folds: int = 3, least: int = 30) -> DataFrame:
    """Add ``shift``, ``lo_c`` and ``hi_c`` to rows with lo, hi and y (null where it is not known yet).

    The shift of an origin is the quantile of how far y lay outside lo and hi (below 0 inside) in the
    group's rows of the ``folds`` origins before; so an interval holds y with a chance of ``cover`` as
    long as errors stay alike. Fewer than ``least`` such rows leave the interval as it is. Origins are
    numbered by their order; each group's origins meet in one small table.
    """
    origins = rows.select(origin).distinct()
    listed = origins.agg(F.array_sort(F.collect_list(origin)).alias("o")).scalar()
    numbered = rows.withColumn("_t", F.array_position(listed, F.col(origin)).cast("int"))
    score = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))
    # a row counts for each of the next origins
    past = numbered.where(F.col("y").isNotNull()).select(*group, score.alias("_e"), F.explode(F.sequence(F.col("_t") + 1, F.col("_t") + folds)).alias("_t"))
    told = exact_quantiles(past, [*group, "_t"], "_e", {"_q": cover}).where(F.col("n_rows") >= least).select(*group, "_t", "_q")
    out = numbered.join(told, [*group, "_t"], "left").withColumn("shift", F.coalesce("_q", F.lit(0.0)))
    lo = F.greatest(F.col("lo") - F.col("shift"), F.lit(0.0))
    return out.withColumns({"lo_c": lo, "hi_c": F.greatest(F.col("hi") + F.col("shift"), lo)}).drop("_t", "_q")
