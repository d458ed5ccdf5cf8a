"""A temporal convolution network on lookback windows.

Layers look at a point and at one that lies 1, 2, 4 … periods before it, never ahead (Bai, Kolter &
Koltun 2018), so a few layers reach back over a long window with few weights. Each layer adds to what
it got. Training is by full batches: every task adds up the gradient of its rows, Spark adds the sums,
and the driver takes a step. Weights and the state of the steps are stored after every epoch, so a
training that was cut off goes on from its last epoch and ends where it would have ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_col, shift_period
from ..functions.runtime import durable
from .learn import tails, windows


@dataclass
class Tcn:
    size: int  # length of a window
    channels: int
    layers: int
    flat: np.ndarray  # all weights
    mean: float
    sd: float

    @classmethod
    def start(cls, size: int, channels: int, mean: float, sd: float, seed: int) -> Tcn:
        """As many layers as it takes to see the whole window."""
        layers = max(1, int(np.ceil(np.log2(max(2, size)))))
        net = cls(size, channels, layers, np.zeros(0), mean, sd)
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, 1 / np.sqrt(max(1, shape[0])), shape) if len(shape) > 1 else np.zeros(shape) for shape in net.shapes()]
        return replace(net, flat=np.concatenate([p.ravel() for p in parts]))

    def shapes(self) -> list[tuple[int, ...]]:
        c = self.channels
        return [(1, c), (c,), *[s for _ in range(self.layers) for s in ((c, c), (c, c), (c,))], (c, 1), (1,)]

    def parts(self) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes():
            n = int(np.prod(shape))
            out.append(self.flat[at : at + n].reshape(shape))
            at += n
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.log1p(np.maximum(x, 0)) - self.mean) / self.sd

    @staticmethod
    def _before(h: np.ndarray, by: int) -> np.ndarray:
        """Each point's value ``by`` periods before; zero in front."""
        out = np.zeros_like(h)
        out[:, by:] = h[:, : h.shape[1] - by] if by < h.shape[1] else 0
        return out

    def _forward(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        w, b, *rest = self.parts()
        h = self.scaled(x)[:, :, None] @ w + b
        kept = []
        for layer in range(self.layers):
            now, past, bias = rest[3 * layer : 3 * layer + 3]
            act = np.tanh(h @ now + self._before(h, 2**layer) @ past + bias)
            kept.append((h, act))
            h = h + act
        kept.append((h, None))
        return kept, h[:, -1] @ rest[-2][:, 0] + rest[-1][0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.expm1(self._forward(x)[1] * self.sd + self.mean), 0.0)

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed half squared error in scaled log demand, and its gradient in the order of ``flat``."""
        kept, z = self._forward(x)
        rest = self.parts()[2:]
        e = z - self.scaled(y)
        last = kept[-1][0][:, -1]
        tail = [last.T @ e, np.array([e.sum()])]
        back = np.zeros_like(kept[-1][0])
        back[:, -1] = np.outer(e, rest[-2][:, 0])
        grads: list[np.ndarray] = []
        for layer in reversed(range(self.layers)):
            now, past, _ = rest[3 * layer : 3 * layer + 3]
            h, act = kept[layer]
            inner = back * (1 - act * act)
            pair = lambda a: np.tensordot(a, inner, axes=([0, 1], [0, 1]))
            grads = [pair(h), pair(self._before(h, 2**layer)), inner.sum(axis=(0, 1)), *grads]
            ahead = inner @ past.T
            by = 2**layer
            shifted = np.zeros_like(ahead)
            if by < ahead.shape[1]:
                shifted[:, :-by] = ahead[:, by:]
            back = back + inner @ now.T + shifted
        first = [np.tensordot(self.scaled(x)[:, :, None], back, axes=([0, 1], [0, 1])), back.sum(axis=(0, 1))]
        return 0.5 * float(e @ e), np.concatenate([g.ravel() for g in (*first, *grads, *tail)])


def _added_up(data: DataFrame, net: Tcn, rows: int = 2048) -> np.ndarray:
    """(rows, loss, gradient…) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, np.zeros(len(net.flat))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = b.column(1).to_numpy(zero_copy_only=False)
                for a in range(0, len(x), rows):
                    part, g = net.loss_gradient(x[a : a + rows], y[a : a + rows])
                    loss, grad = loss + part, grad + g
                n += b.num_rows
        if n:
            values = np.concatenate([[n, loss], grad])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

    # a fixed order of the terms makes the sum the same on every run
    ordered = F.aggregate(F.sort_array(F.collect_list("v")), F.lit(0.0), lambda a, b: a + b)
    got = data.mapInArrow(run, "i int, v double").groupBy("i").agg(ordered.alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])


STATE = "epoch int, mean double, sd double, flat array<double>, m1 array<double>, m2 array<double>"


def fit_tcn(train: DataFrame, L: int, channels: int = 8, epochs: int = 60, rate: float = 0.02, seed: int = 1, store: str | None = None) -> Tcn:
    """Learn from windows (``lookback`` of length L, ``target``).

    With ``store``, a folder that all machines share, every epoch's weights are written there, and a
    call that finds some goes on behind the last of them.
    """
    spark = train.sparkSession
    data = durable(train.select("lookback", F.col("target").cast("double")))
    last = None
    if store:
        spark.createDataFrame([], STATE).write.mode("append").parquet(store)
        last = spark.read.schema(STATE).parquet(store).orderBy(F.desc("epoch")).first()
    if last:
        net = replace(Tcn.start(L, channels, last.mean, last.sd, seed), flat=np.array(last.flat))
        m1, m2, done = np.array(last.m1), np.array(last.m2), last.epoch
    else:
        st = data.select(F.explode("lookback").alias("x")).agg(F.avg(F.log1p("x")).alias("m"), F.stddev_pop(F.log1p("x")).alias("s")).first()
        net = Tcn.start(L, channels, float(st["m"] or 0.0), float(st["s"] or 0.0) or 1.0, seed)
        m1, m2, done = np.zeros_like(net.flat), np.zeros_like(net.flat), 0
    for t in range(done + 1, epochs + 1):
        total = _added_up(data, net)
        if not len(total):
            break
        g = total[2:] / total[0]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        net = replace(net, flat=net.flat - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8))
        if store:
            state = [(t, net.mean, net.sd, net.flat.tolist(), m1.tolist(), m2.tolist())]
            spark.createDataFrame(state, STATE).coalesce(1).write.mode("append").parquet(store)
    return net


def forecast_tcn(panel: DataFrame, keys: list[str], freq: str, origin, H: int, L: int, net: Tcn | None = None, name: str = "tcn", **fit) -> DataFrame:
    """Forecasts 1 to H steps after ``origin`` from a one-step network fed with its own forecasts.

    Without ``net`` one is trained on the windows whose target is known at ``origin``. A series shorter
    than the window has zeros in front, so every series gets its forecasts.
    """
    if net is None:
        net = fit_tcn(windows(panel.where(F.col("period") <= as_col(origin)), keys, L), L, **fit)

    @F.pandas_udf("array<double>")
    def steps(look: pd.Series) -> pd.Series:
        if not len(look):
            return pd.Series([], dtype=object)
        x, out = np.stack(look.to_numpy()).astype(np.float64), []
        for _ in range(H):
            out.append(net.predict(x))
            x = np.column_stack([x[:, 1:], out[-1]])
        return pd.Series(list(np.column_stack(out)))

    rows = tails(panel, keys, freq, origin, L).withColumn("_f", steps("lookback"))
    h = F.col("_i") + 1
    return rows.select(*keys, "origin", F.posexplode("_f").alias("_i", "yhat")).select(
        *keys, "origin", F.lit(name).alias("model"), h.alias("h"), shift_period("origin", h, freq).alias("period"), "yhat"
    )
