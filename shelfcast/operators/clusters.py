"""Clustering-based demand segmentation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ratio
from ..functions.ranks import exact_quantiles
from ..functions.runtime import bounded_rows, durable
from ..functions.vectors import lit_json, squared_distance


def cluster_input(profile: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """z-scores of the columns (population sd), nulls as the mean; a constant column becomes 0.

    Means and sds are one row, read as a scalar subquery.
    """
    stats = profile.agg(
        F.struct(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])
    ).scalar()
    both = profile.select(*keys, *cols, stats.alias("_st"))
    z = lambda c: F.coalesce(
        F.when(F.col(f"_st.{c}_s") > 1e-12, (F.col(c) - F.col(f"_st.{c}_m")) / F.col(f"_st.{c}_s")), F.lit(0.0)
    )
    return both.select(*keys, *[z(c).alias(c) for c in cols])


def to_vector(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))


def steady_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fixed row order, so that a seeded fit gives the same model on every run over the same data.

    The number of partitions is left to AQE, which merges small ones: training on little data is not
    spread over hundreds of tiny tasks per iteration.
    """
    order = [*keys, "period"] if "period" in df.columns and "period" not in keys else keys
    return df.repartition(*keys).sortWithinPartitions(*order)


def _fit(df: DataFrame, keys: list[str], cols: list[str], estimator) -> tuple[DataFrame, object]:
    vec = steady_order(to_vector(df, cols), keys)
    model = estimator.setFeaturesCol("features").setPredictionCol("cluster").fit(vec)
    return model.transform(vec), model


def kmeans(df: DataFrame, keys: list[str], cols: list[str], k: int, seed: int = 1):
    """(rows with ``cluster``, model) by k-means‖."""
    from pyspark.ml.clustering import KMeans

    out, model = _fit(df, keys, cols, KMeans(k=k, seed=seed, maxIter=30))
    return out.drop("features"), model


def bisecting(df: DataFrame, keys: list[str], cols: list[str], k: int, seed: int = 1):
    """(rows with ``cluster``, model) by top-down splitting."""
    from pyspark.ml.clustering import BisectingKMeans

    out, model = _fit(df, keys, cols, BisectingKMeans(k=k, seed=seed))
    return out.drop("features"), model


@dataclass
class Mixture:
    """Gaussian components: weights (k), means (k × d) and covariances (k × d × d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows × components."""
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, j] = np.log(max(w, 1e-300)) - (z * z).sum(axis=0) / 2 - np.log(np.diag(low)).sum() - len(m) / 2 * np.log(2 * np.pi)
        return out

    def memberships(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(probability of each component per row, log likelihood of all rows)."""
        logs = self.log_densities(x)
        most = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - most)
        total = p.sum(axis=1, keepdims=True)
        return p / total, float((most + np.log(total)).sum())

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What a step needs of some rows, as one vector: rows, log likelihood, and Σp, Σpx, Σpxxᵀ per component."""
        p, like = self.memberships(x)
        square = np.einsum("nk,ni,nj->kij", p, x, x, optimize=True)
        return np.concatenate([[len(x), like], p.sum(axis=0), (p.T @ x).ravel(), square.ravel()])

    def step(self, sums: np.ndarray, least: float) -> Mixture:
        """The most likely mixture for these sums; ``least`` is added to the variances."""
        k, d = self.means.shape
        n = np.maximum(sums[2 : 2 + k], 1e-12)
        means = sums[2 + k : 2 + k + k * d].reshape(k, d) / n[:, None]
        square = sums[2 + k + k * d :].reshape(k, d, d) / n[:, None, None]
        cov = square - np.einsum("ki,kj->kij", means, means) + least * np.eye(d)
        return Mixture(n / n.sum(), means, cov)


def gmm(df: DataFrame, keys: list[str], cols: list[str], k: int, seed: int = 1, iterations: int = 50, tolerance: float = 1e-4):
    """(rows with ``cluster`` and membership ``p_0``…, model) by a Gaussian mixture.

    The components start at the centres of k-means, each with the spread of all rows over the number of
    components: a random start may give two groups one component. Every step adds up one vector per
    task, of a size that depends on k and the columns alone; it stops when the mean log likelihood
    grows by less than ``tolerance``. Rows with a null in ``cols`` have no cluster.
    """
    values = df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    known = durable(values.where(~F.exists("_x", lambda v: v.isNull())))
    _, centres = kmeans(df.dropna(subset=cols), keys, cols, k, seed)
    scale = known.select(*[F.var_pop(F.get("_x", F.lit(i))).alias(f"v{i}") for i in range(len(cols))]).first()
    spread = np.diag([max(v or 0.0, 1e-12) for v in scale])
    least = 1e-9 * float(np.trace(spread)) / len(cols)
    means = np.array(centres.clusterCenters())
    model = Mixture(np.full(len(means), 1 / len(means)), means, np.repeat(spread[None] / len(means) ** 2, len(means), axis=0) + least * np.eye(len(cols)))
    before = -np.inf
    for _ in range(iterations):
        total = _added_up(known, model)
        model = model.step(total, least)
        if total[1] / total[0] - before < tolerance:
            break
        before = total[1] / total[0]

    @F.pandas_udf("array<double>")
    def memberships(rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype=object)
        some = [i for i, x in enumerate(rows) if not np.isnan(np.asarray(x, float)).any()]
        if some:
            out.iloc[some] = list(model.memberships(np.stack([np.asarray(rows.iloc[i], float) for i in some]))[0])
        return out

    p = memberships(F.array(*[F.col(c).cast("double") for c in cols]))
    found = df.withColumn("_p", p)
    cluster = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
    return found.select(*df.columns, cluster.alias("cluster"), *[F.get("_p", F.lit(i)).alias(f"p_{i}") for i in range(len(means))]), model


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added_up(rows: DataFrame, model: Mixture) -> np.ndarray:
    """The sums of all rows; one vector per task is shuffled, in an order that does not depend on the tasks."""
    d = model.means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(model.sums(_matrix(b.column(0), d)) for b in batches if b.num_rows)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    ordered = F.aggregate(F.sort_array(F.collect_list("v")), F.lit(0.0), lambda a, b: a + b)
    got = rows.select("_x").mapInArrow(run, "i int, v double").groupBy("i").agg(ordered.alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])


def choose_k(df: DataFrame, keys: list[str], cols: list[str], ks: list[int], seed: int = 1) -> DataFrame:
    """Mean silhouette and within-cluster cost for each k, best first. One row per k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    # written rather than cached: a cached frame keeps one partition per shuffle partition
    vec = durable(steady_order(to_vector(df, cols), keys).select("features"))
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=30, predictionCol="cluster").fit(vec)
        quality = ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(vec))
        rows.append((k, float(quality), float(model.summary.trainingCost)))
    rows.sort(key=lambda r: (-r[1], r[0]))
    ranked = [(i + 1, *r) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(ranked, "rank int, k int, silhouette double, cost double")


def centroids_of(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Mean of the columns per label."""
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


def model_centroids(model, cols: list[str], spark) -> DataFrame:
    """The centres of a fitted k-means or bisecting model as a frame."""
    rows = [(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"`{c}` double" for c in cols))


def assign(df: DataFrame, centroids: DataFrame, label: str, cols: list[str], most: int = 100_000) -> DataFrame:
    """Nearest centroid of each row as ``cluster``, with its ``distance``; ties by label.

    The centroids, checked to be at most ``most``, become one literal: no join, no shuffle, and new
    series can be assigned long after the fit.
    """
    rows = bounded_rows(centroids.select(label, *cols).orderBy(label), most, "centroids")
    kind = centroids.schema[label].dataType.simpleString()
    points = [{"id": r[label], "v": [float(r[c]) for c in cols]} for r in rows]
    table = lit_json(points, f"array<struct<id: {kind}, v: array<double>>>")
    x = F.array(*[F.col(c).cast("double") for c in cols])
    with_x = df.withColumn("_x", x)
    # equal distances differ in their last bits only; ten places make them equal
    near = F.array_min(
        F.transform(table, lambda c: F.struct(F.round(squared_distance(F.col("_x"), c["v"]), 10).alias("d"), c["id"].alias("id")))
    )
    return (
        with_x.withColumn("_near", near)
        .withColumns({"cluster": F.col("_near.id"), "distance": F.sqrt("_near.d")})
        .drop("_x", "_near")
    )


def cluster_profile(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Size, mean and quartiles of every column in every cluster, in long form.

    Quartiles come from the ranked value counts, so a cluster of any size is handled exactly.
    """
    long = df.select(label, *cols).unpivot([label], cols, "feature", "value")
    means = long.groupBy(label, "feature").agg(F.count("*").alias("size"), F.avg("value").alias("mean"))
    quart = exact_quantiles(long, [label, "feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return means.join(quart.drop("n_rows"), [label, "feature"])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair of labels."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand index of two labelings, from label counts only (no pair of rows is built).

    One pass: the counts are rolled up to each labeling and to the total by grouping sets.
    """
    cells = contingency(df, a, b)
    sums = cells.groupingSets([[F.col(a), F.col(b)], [F.col(a)], [F.col(b)], []], a, b).agg(
        F.grouping_id().alias("_id"), F.sum("n").alias("_n")
    )
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    part = lambda i: F.coalesce(F.sum(F.when(F.col("_id") == i, pairs)), F.lit(0.0))
    out = sums.agg(
        F.max(F.when(F.col("_id") == 3, F.col("_n"))).alias("n_rows"),
        part(0).alias("_both"), part(1).alias("_a"), part(2).alias("_b"), part(3).alias("_all"),
    )
    together = F.col("_all") + 2 * F.col("_both") - F.col("_a") - F.col("_b")
    return out.select("n_rows", ratio(together, "_all").alias("rand_index"))
