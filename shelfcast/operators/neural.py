"""Feed-forward networks on lookback windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.columns import as_col, shift_period
from ..functions.ranks import exact_quantiles
from ..functions.runtime import durable
from ..functions.vectors import lit_json
from .clusters import steady_order
from .learn import tails, windows


def bin_bounds(train: DataFrame, n: int, col: str = "target") -> list[float]:
    """Distinct inner quantile bounds (at most n − 1 numbers) of the target."""
    if n < 2:
        raise ValueError("a single bin tells nothing")
    probs = {f"q{i}": i / n for i in range(1, n)}
    row = exact_quantiles(train, [], col, probs).first()
    return sorted({float(row[q]) for q in probs if row[q] is not None})


def bin_of(value: Column, bounds: list[float]) -> Column:
    """Bin number: how many bounds lie below the value."""
    return F.size(F.filter(F.lit([float(b) for b in bounds]).cast("array<double>"), lambda b: value > b))


def bins(train: DataFrame, n: int, col: str = "target") -> DataFrame:
    """Quantile bins of the training target: bin, rows, lo, hi and mean. Bins are (bound, bound]."""
    bounds = bin_bounds(train, n, col)
    return train.groupBy(bin_of(F.col(col), bounds).alias("bin")).agg(
        F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("mean")
    )


@dataclass
class BinsNet:
    """A network that gives the probability of each target bin."""

    pipeline: object
    means: list[float]


def _inputs(windows: DataFrame, L: int) -> DataFrame:
    return windows.withColumns({f"_x{i}": F.log1p(F.get("lookback", F.lit(i))) for i in range(L)})


def fit_nn_bins(train: DataFrame, keys: list[str], L: int, n_bins: int = 5, hidden: tuple[int, ...] = (8,), epochs: int = 30, seed: int = 1) -> BinsNet:
    """Multilayer perceptron from the log of the window to the bin of the target."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    bounds = bin_bounds(train, n_bins)
    labelled = train.withColumn("_bin", bin_of(F.col("target"), bounds))
    means = {r["_bin"]: r["m"] for r in labelled.groupBy("_bin").agg(F.avg("target").alias("m")).collect()}
    # a bound at the largest value leaves its upper bin empty: number the bins that occur
    order = sorted(means)
    index = F.element_at(F.array(*[F.lit(float(order.index(b) if b in means else -1)) for b in range(max(order) + 1)]), F.col("_bin") + 1)
    labelled = _inputs(labelled.withColumn("_label", index), L)
    stages = [
        VectorAssembler(inputCols=[f"_x{i}" for i in range(L)], outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_s", withMean=True),
        MultilayerPerceptronClassifier(
            layers=[L, *hidden, len(order)], maxIter=epochs, seed=seed, blockSize=128, labelCol="_label",
            featuresCol="_s", probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw",
        ),
    ]
    cols = [*keys, "period", *[f"_x{i}" for i in range(L)], "_label"]
    return BinsNet(Pipeline(stages=stages).fit(steady_order(labelled.select(*cols), keys)), [means[b] for b in order])


def predict_nn_bins(rows: DataFrame, keys: list[str], L: int, net: BinsNet, name: str = "nn_bins") -> DataFrame:
    """Forecast = sum of bin probability × bin mean."""
    from pyspark.ml.functions import vector_to_array

    means = lit_json(net.means, "array<double>")
    out = net.pipeline.transform(_inputs(rows, L))
    yhat = F.aggregate(F.zip_with(vector_to_array("_prob"), means, lambda p, m: p * m), F.lit(0.0), lambda s, v: s + v)
    return out.select(*keys, "origin", F.lit(name).alias("model"), "h", "period", yhat.alias("yhat"))


# ---- one hidden layer, trained by summed gradients ----------------------------------------------


@dataclass
class Net:
    """tanh hidden layer and linear output on scaled log demand."""

    w1: np.ndarray  # L × hidden
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    mean: float
    sd: float

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w1.ravel(), self.b1, self.w2, [self.b2]])

    def with_flat(self, v: np.ndarray) -> "Net":
        L, h = self.w1.shape
        cut = np.cumsum([L * h, h, h])
        a, b, c, d = np.split(v, cut)
        return Net(a.reshape(L, h), b, c, float(d[0]), self.mean, self.sd)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.log1p(x) - self.mean) / self.sd

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(self.scaled(x) @ self.w1 + self.b1) @ self.w2 + self.b2
        return np.maximum(np.expm1(z * self.sd + self.mean), 0.0)

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed half squared error in scaled log demand, and its gradient in the order of ``flat``."""
        s = self.scaled(x)
        a = np.tanh(s @ self.w1 + self.b1)
        e = a @ self.w2 + self.b2 - self.scaled(y)
        back = np.outer(e, self.w2) * (1 - a * a)
        return 0.5 * float(e @ e), np.concatenate([(s.T @ back).ravel(), back.sum(0), a.T @ e, [e.sum()]])


def _gradient_rows(net: Net):
    def run(batches: Iterator[pa.RecordBatch]):
        loss, grad, n = 0.0, np.zeros(len(net.flat())), 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                part, g = net.loss_gradient(x, b.column(1).to_numpy(zero_copy_only=False))
                loss, grad, n = loss + part, grad + g, n + b.num_rows
        if n:
            values = np.concatenate([[n, loss], grad])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    return run


def fit_nn(train: DataFrame, L: int, hidden: int = 8, epochs: int = 40, rate: float = 0.05, seed: int = 1) -> Net:
    """Full-batch training: every task sums the gradient of its rows, Spark adds the sums.

    Per epoch one vector of the network's size per task is shuffled and one reaches the driver, which
    takes an Adam step; the rows stay where they are.
    """
    logs = train.select(F.explode("lookback").alias("x")).agg(
        F.avg(F.log1p("x")).alias("m"), F.stddev_pop(F.log1p("x")).alias("s")
    )
    st: Row = logs.first()
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 1 / np.sqrt(L), (L, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0,
        float(st["m"]), float(st["s"]) or 1.0,
    )
    # written once: every epoch reads it, and a lost executor costs a re-read
    data = durable(train.select(F.col("lookback"), F.col("target").cast("double")))
    v = net.flat()
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, epochs + 1):
        # tasks end in any order: a fixed order of the terms makes the sum the same on every run
        ordered = F.aggregate(F.sort_array(F.collect_list("v")), F.lit(0.0), lambda a, b: a + b)
        sums = data.mapInArrow(_gradient_rows(net), "i int, v double").groupBy("i").agg(ordered.alias("v")).collect()
        total = np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])
        if not len(total):
            break
        g = total[2:] / total[0]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v = v - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        net = net.with_flat(v)
    return net


def predict_nn(rows: DataFrame, keys: list[str], net: Net, name: str = "nn") -> DataFrame:
    """Apply a trained network to windows in Arrow batches."""

    @F.pandas_udf("double")
    def apply(look: pd.Series) -> pd.Series:
        if not len(look):
            return pd.Series([], dtype=float)
        return pd.Series(net.predict(np.stack(look.to_numpy()).astype(np.float64)))

    return rows.select(*keys, "origin", F.lit(name).alias("model"), "h", "period", apply("lookback").alias("yhat"))


def forecast_nn(panel: DataFrame, keys: list[str], freq: str, origin, H: int, L: int, net: Net | None = None, name: str = "nn", **fit) -> DataFrame:
    """Forecasts 1 to H steps after ``origin`` from a one-step network fed with its own forecasts.

    Without ``net`` one is trained on the windows whose target is known at ``origin``. A series shorter
    than the window has zeros in front, so every series gets its forecasts; all steps of a batch of
    series are made at once, where the series lie.
    """
    if net is None:
        net = fit_nn(windows(panel.where(F.col("period") <= as_col(origin)), keys, L), L, **fit)

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
    return rows.select(*keys, "origin", F.posexplode("_f").alias("_i", "yhat")).select(
        *keys, "origin", F.lit(name).alias("model"), (F.col("_i") + 1).alias("h"),
        shift_period("origin", F.col("_i") + 1, freq).alias("period"), "yhat",
    )
