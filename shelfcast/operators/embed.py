"""Time-series embeddings and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import isax
from ..functions.columns import as_col, shift_period
from ..functions.runtime import durable
from ..functions.vectors import _unit, topk_cosine
from .clusters import cluster_input, steady_order
from .panel import by_series


def zscore_array(a: Column, mean: Column, sd: Column) -> Column:
    """z-scored array; a constant one becomes zeros."""
    return F.transform(a, lambda x: F.when(sd > 1e-9, (x - mean) / sd).otherwise(0.0))


def scaled_windows(windows: DataFrame, L: int, col: str = "lookback") -> DataFrame:
    """Add win_mean, win_sd and ``emb``, the z-scored window."""
    df = windows.withColumn("win_mean", F.aggregate(col, F.lit(0.0), lambda s, x: s + x) / L)
    spread = F.aggregate(col, F.lit(0.0), lambda s, x: s + (x - F.col("win_mean")) * (x - F.col("win_mean")))
    df = df.withColumn("win_sd", F.sqrt(spread / L))
    return df.withColumn("emb", zscore_array(F.col(col), F.col("win_mean"), F.col("win_sd")))


def embed_pca(windows: DataFrame, keys: list[str], k: int, col: str = "emb"):
    """(rows with ``pc_1``…, model): principal components of the z-scored windows."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = steady_order(windows.withColumn("_v", array_to_vector(col)), keys)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vec)
    pc = vector_to_array("_pc")
    return model.transform(vec).select(*windows.columns, *[pc[i].alias(f"pc_{i + 1}") for i in range(k)]), model


def sax(panel: DataFrame, keys: list[str], w: int, a: int) -> DataFrame:
    """SAX word per series: w segment means of the z-scored series as a letters of equal probability."""
    s = W.partitionBy(*keys)
    sd = F.stddev_pop("qty").over(s)
    z = F.when(sd > 1e-12, (F.col("qty") - F.avg("qty").over(s)) / sd).otherwise(0.0)
    rows = panel.select(
        *keys,
        z.alias("_z"),
        F.floor((F.row_number().over(by_series(keys)) - 1) * w / F.count("*").over(s)).cast("int").alias("segment"),
    )
    means = rows.groupBy(*keys, "segment").agg(F.avg("_z").alias("_m"))
    cuts = [NormalDist().inv_cdf(i / a) for i in range(1, a)]
    above = sum((F.col("_m") >= c).cast("int") for c in cuts)
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"[:a]), above + 1, F.lit(1))
    letters = means.select(*keys, "segment", letter.alias("letter"))
    ordered = F.sort_array(F.collect_list(F.struct("segment", "letter")))
    out = letters.groupBy(*keys).agg(F.transform(ordered, lambda x: x["letter"]).alias("letters"))
    return out.withColumn("word", F.array_join("letters", ""))


def embed_word2vec(words: DataFrame, keys: list[str], dim: int, seed: int = 1, col: str = "letters"):
    """(rows with ``emb``, model): a series is the mean of its letters' vectors."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    ordered = steady_order(words, keys)
    model = Word2Vec(vectorSize=dim, seed=seed, minCount=0, maxIter=3, inputCol=col, outputCol="_v").fit(ordered)
    return model.transform(ordered).withColumn("emb", vector_to_array("_v")).drop("_v"), model


def embed_stats(profile: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Standardised profile statistics as one array per series."""
    return cluster_input(profile, cols, keys).select(*keys, F.array(*cols).alias("emb"))


def topk(vectors: DataFrame, queries: DataFrame, k: int, id: str = "id", emb: str = "emb") -> DataFrame:
    """The k most cosine-similar vectors of each query, exactly."""
    return topk_cosine(vectors, queries, k, id, emb)


def lsh_pairs(
    vectors: DataFrame,
    queries: DataFrame,
    d: float,
    bucket: float,
    id: str = "id",
    emb: str = "emb",
    tables: int = 5,
    seed: int = 1,
) -> DataFrame:
    """Approximate (query, vector) pairs within Euclidean distance d, by random projections.

    Work grows with the candidates that queries meet in their buckets; the query side is a frame of any
    size. Equal vectors are hashed and compared once and expanded at the end, so a large group of copies
    is no hot bucket.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    as_vec = lambda c: array_to_vector(F.transform(c, lambda x: x.cast("double")))
    members = vectors.select(F.col(id).alias("neighbour_id"), F.col(emb).alias("_e"), F.xxhash64(emb).alias("_hash"))
    distinct = members.groupBy("_hash", "_e").agg(F.count("*").alias("copies")).withColumn("_v", as_vec("_e"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed
    ).fit(distinct)
    left = queries.select(F.col(id).alias("query_id"), as_vec(emb).alias("_v"))
    pairs = lsh.approxSimilarityJoin(left, distinct.select("_hash", "_e", "_v"), d, distCol="distance").select(
        F.col("datasetA.query_id").alias("query_id"),
        F.col("datasetB._hash").alias("_hash"),
        F.col("datasetB._e").alias("_e"),
        "distance",
    )
    return pairs.join(members, ["_hash", "_e"]).select("query_id", "neighbour_id", "distance")


def _own_steps(y: np.ndarray, H: int, L: int, k: int) -> np.ndarray:
    """``analog_own`` for series of one length, a row each; NaN is an unknown value. Returns H steps per row.

    Sums run over the positions of a window in order, so they are those of a fold over its array.
    """
    n = y.shape[1]
    total = lambda at, size: sum((at(j) for j in range(size)), 0.0)
    size = min(n, L)
    flat = total(lambda j: y[:, n - size + j], size) / size
    out = np.repeat(flat[:, None], H, axis=1)
    if n < 2 * L + H:
        return out
    now = y[:, n - L :]
    mean = total(lambda j: now[:, j], L) / L
    sd = np.sqrt(total(lambda j: (now[:, j] - mean) ** 2, L) / L)
    rows = np.flatnonzero(sd > 1e-9)
    if not len(rows):
        return out
    y, now, mean, sd = y[rows], now[rows], mean[rows], sd[rows]
    starts = n - L - H + 1
    at = lambda j: y[:, j : j + starts]
    m = total(at, L) / L
    d = np.sqrt(total(lambda j: (at(j) - m) ** 2, L) / L)
    varied = d > 1e-9
    scale = np.where(varied, d, 1.0)
    q = (now - mean[:, None]) / sd[:, None]
    dot = total(lambda j: q[:, j : j + 1] * ((at(j) - m) / scale), L)
    similarity = np.where(varied, np.round(dot / L, 9), -np.inf)
    # on equal similarity the later window: a stable order of the windows taken from the end
    top = starts - 1 - np.argsort(-similarity[:, ::-1], axis=1, kind="stable")[:, :k]
    used = np.take_along_axis(varied, top, axis=1)
    tm, td = (np.take_along_axis(a, top, axis=1) for a in (m, scale))
    found = used.sum(axis=1)
    some = found > 0
    for i in range(H):
        after = (np.take_along_axis(y, top + L + i, axis=1) - tm) / td
        f = total(lambda j: np.where(used[:, j], after[:, j], 0.0), top.shape[1])
        out[rows[some], i] = (mean + sd * f / np.maximum(found, 1))[some]
    return out


#: Series whose windows are worked out at once.
OWN_ROWS = 512


def analog_own(panel: DataFrame, keys: list[str], freq: str, origin, H: int, L: int, k: int) -> DataFrame:
    """Forecast from the k past windows of the same series that look most like its latest window.

    What followed each of them, measured in its own mean and sd, is averaged and scaled to the latest
    window. A past window must end at least H periods before ``origin``. A series that has none, or is
    constant in its latest window, gets the mean of that window (of what there is of it). A series is
    one bounded array, so this is linear in the number of series.
    """
    at = as_col(origin)
    known = panel.where(F.col("period") <= at)
    s = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period", F.col("qty").cast("double").alias("y")))).alias("_p"))
    s = s.select(*keys, F.transform("_p", lambda p: p["y"]).alias("_y"))
    out = s.select(*keys, F.col("_y").alias("_steps")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = np.asarray(lists.value_lengths())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            steps = np.empty((batch.num_rows, H))
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for part in (rows[i : i + OWN_ROWS] for i in range(0, len(rows), OWN_ROWS)):
                    with np.errstate(invalid="ignore"):
                        steps[part] = _own_steps(values[begins[part][:, None] + np.arange(n)], H, L, k)
            flat = pa.array(steps.ravel(), pa.float64(), from_pandas=True)
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * H, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*keys, "_steps"])

    steps = s.mapInArrow(run, out)
    return steps.select(*keys, F.posexplode("_steps").alias("_h", "yhat")).select(
        *keys, at.alias("origin"), F.lit("analog_own").alias("model"), (F.col("_h") + 1).alias("h"),
        shift_period(at, F.col("_h") + 1, freq).alias("period"), "yhat",
    )


def _every_step(flat: DataFrame, fc: DataFrame, keys: list[str], freq: str, origin, H: int, name: str) -> DataFrame:
    """Forecast frame with a row per series of ``flat`` and step: yhat of ``fc``, else ``_flat``."""
    at = as_col(origin)
    steps = flat.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(H)))).join(fc, [*keys, "h"], "left")
    return steps.select(
        *keys, at.alias("origin"), F.lit(name).alias("model"), "h", shift_period(at, F.col("h"), freq).alias("period"),
        F.coalesce("yhat", "_flat").alias("yhat"),
    )


def analog(
    panel: DataFrame, keys: list[str], freq: str, origin, H: int, L: int, k: int,
    search: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, name: str = "analog",
) -> DataFrame:
    """As ``analog_own``, with the past windows of all series as candidates (exact search).

    A window is named by its series and last period, which also decides between equal similarities. A
    series that is short or constant in its latest window gets the mean of that window.
    ``search`` finds the k windows most like each query: by default every window is compared, so work
    is series × windows; ``analog_indexed`` compares only windows that an index does not rule out.
    """
    w = by_series(keys)
    at = as_col(origin)
    known = panel.where(F.col("period") <= at)
    rows = known.select(
        *keys,
        "period",
        F.collect_list("qty").over(w.rowsBetween(-L + 1, 0)).alias("lookback"),
        F.collect_list("qty").over(w.rowsBetween(1, H)).alias("next"),
    ).where(F.size("lookback") == L)
    # quantities repeat and take little space when stored; their z-scores do not, and are worked out where they are read
    rows = durable(scaled_windows(rows, L).drop("emb"), tidy=True)
    rows = rows.withColumn("emb", zscore_array(F.col("lookback"), F.col("win_mean"), F.col("win_sd"))).withColumn("id", F.concat_ws("|", *keys, "period"))
    past = rows.where((F.size("next") == H) & (F.col("win_sd") > 1e-9))
    now = rows.where((F.col("period") == at) & (F.col("win_sd") > 1e-9))
    recent = known.where(F.col("period") > shift_period(at, -L, freq))
    flat = known.select(*keys).distinct().join(recent.groupBy(*keys).agg(F.avg("qty").alias("_flat")), keys, "left")
    near = (search or topk)(past, now, k)
    scale = now.select(F.col("id").alias("query_id"), *keys, F.col("win_mean").alias("_mean"), F.col("win_sd").alias("_sd"))
    then = past.select(F.col("id").alias("neighbour_id"), "next", F.col("win_mean").alias("m"), F.col("win_sd").alias("d"))
    steps = near.join(then, "neighbour_id").select("query_id", "m", "d", F.posexplode("next").alias("_h", "_v"))
    mean = steps.groupBy("query_id", (F.col("_h") + 1).alias("h")).agg(F.avg((F.col("_v") - F.col("m")) / F.col("d")).alias("_f"))
    fc = mean.join(scale, "query_id").select(*keys, "h", (F.col("_mean") + F.col("_sd") * F.col("_f")).alias("yhat"))
    return _every_step(flat.fillna(0.0, ["_flat"]), fc, keys, freq, origin, H, name)


def analog_indexed(panel: DataFrame, keys: list[str], freq: str, origin, H: int, L: int, k: int) -> DataFrame:
    """The forecasts of ``analog`` through an index of words of several resolutions (``functions.isax``)."""
    search = lambda past, now, k: isax.topk(past, now, k, emb="lookback", unit=_unit_windows)
    return analog(panel, keys, freq, origin, H, L, k, search, "analog_indexed")


def _unit_windows(x: np.ndarray) -> np.ndarray:
    """Windows as z-scores of length 1; sums run in order, so these are the numbers that ``scaled_windows`` has in ``emb``."""
    L = x.shape[1]
    mean = (sum((x[:, j] for j in range(L)), 0.0) / L)[:, None]
    sd = np.sqrt(sum(((x[:, j] - mean[:, 0]) ** 2 for j in range(L)), 0.0) / L)[:, None]
    return _unit(np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 1e-9))


def embed_clusters(vectors: DataFrame, keys: list[str], k: int, seed: int = 1, emb: str = "emb"):
    """(rows with ``cluster``, model): k-means in embedding space."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = steady_order(vectors.withColumn("_v", array_to_vector(F.transform(emb, lambda x: x.cast("double")))), keys)
    model = KMeans(k=k, seed=seed, maxIter=30, featuresCol="_v", predictionCol="cluster").fit(vec)
    return model.transform(vec).drop("_v"), model


def add_embeddings(features: DataFrame, vectors: DataFrame, keys: list[str], dim: int, emb: str = "emb") -> DataFrame:
    """Embedding coordinates as columns emb_1… of the feature matrix."""
    cols = [F.get(emb, F.lit(i)).cast("double").alias(f"emb_{i + 1}") for i in range(dim)]
    return features.join(vectors.select(*keys, *cols), keys, "left")
