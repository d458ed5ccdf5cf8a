"""Clusters of series whose shapes agree up to shifts in time.

Distance is dynamic time warping in a band (Sakoe & Chiba 1978) between z-scored series, so a peak two
periods later is still the same peak. Centres are barycentres: every series is laid along its centre by
the cheapest warping, and each point of the centre becomes the mean of what was laid on it (Petitjean,
Ketterlin & Gançarski 2011). The envelope of a centre bounds the distance from below (Keogh &
Ratanamahatana 2005); only centres whose bound is under the best distance so far are warped to.

Series are worked on in Arrow batches where they lie. The centres, k times their length, go to every
task; what comes back per task is one vector of sums of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.rows import map_series, series_rows
from ..functions.runtime import durable

ROWS = 512


def standard(y: np.ndarray, size: int) -> np.ndarray:
    """z-scored rows of ``size`` points; rows of another length are drawn out evenly, constant ones are zero."""
    if y.shape[1] != size:
        at = np.linspace(0, max(y.shape[1] - 1, 0), size)
        y = np.array([np.interp(at, np.arange(len(r)), r) if len(r) else np.zeros(size) for r in y]).reshape(len(y), size)
    z = y - y.mean(axis=1, keepdims=True)
    sd = np.sqrt((z * z).mean(axis=1, keepdims=True))
    return np.divide(z, sd, out=np.zeros_like(z), where=sd > 1e-9)


def warp(a: np.ndarray, b: np.ndarray, band: int, moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(squared warping distance of each row of a to the same row of b, moves). A point may be off by ``band`` places.

    ``moves`` tells for each cell of the band where the cheapest way comes from: 0 both, 1 one back in a, 2 one back in b.
    """
    n, size = a.shape
    width = 2 * band + 1
    kept = np.zeros((size, width, n), "int8") if moves else None
    before = np.full((width + 1, n), np.inf)  # cells of row i - 1; the last one stays infinite
    for i in range(size):
        now = np.full((width + 1, n), np.inf)
        for w in range(max(0, band - i), min(width, size - i + band)):
            j = i + w - band
            cost = (a[:, i] - b[:, j]) ** 2
            if i == j == 0:
                now[w] = cost
                continue
            # row i - 1 holds column j - 1 at w and column j at w + 1
            ways = np.stack([before[w] if j else np.full(n, np.inf), before[w + 1], now[w - 1] if w else np.full(n, np.inf)])
            pick = ways.argmin(axis=0)
            now[w] = ways[pick, np.arange(n)] + cost
            if kept is not None:
                kept[i, w] = pick
        before = now
    return before[band], kept


def laid(a: np.ndarray, kept: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the points of each row of a that were laid on each point of b, how many)."""
    n, size = a.shape
    total, count, rows = np.zeros((n, size)), np.zeros((n, size)), np.arange(n)
    i, j = np.full(n, size - 1), np.full(n, size - 1)
    going = np.ones(n, bool)
    while going.any():
        r = rows[going]
        np.add.at(total, (r, j[r]), a[r, i[r]])
        np.add.at(count, (r, j[r]), 1)
        done = (i[r] == 0) & (j[r] == 0)
        going[r[done]] = False
        r = r[~done]
        move = kept[i[r], j[r] - i[r] + band, r]
        i[r] -= move != 2
        j[r] -= move != 1
    return total, count


def envelopes(centres: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each centre within the band of each point."""
    padded = lambda fill: np.pad(centres, ((0, 0), (band, band)), constant_values=fill)
    views = lambda m: np.stack([m[:, i : i + centres.shape[1]] for i in range(2 * band + 1)])
    return views(padded(np.inf)).min(axis=0), views(padded(-np.inf)).max(axis=0)


def lower_bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows x centres: no warping in the band is cheaper."""
    off = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0)
    return (off * off).sum(axis=2)


def nearest(x: np.ndarray, centres: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centre, squared distance, centres warped to) of each row; of equal ones the first."""
    bounds = lower_bounds(x, *envelopes(centres, band))
    order = np.argsort(bounds, axis=1, kind="stable")
    best, which, tried = np.full(len(x), np.inf), np.full(len(x), len(centres)), np.zeros(len(x), "int64")
    for place in range(len(centres)):
        c = order[:, place]
        near = np.flatnonzero(bounds[np.arange(len(x)), c] <= best)
        if not len(near):
            break
        d = warp(x[near], centres[c[near]], band)[0]
        tried[near] += 1
        better = (d < best[near]) | ((d == best[near]) & (c[near] < which[near]))
        best[near[better]], which[near[better]] = d[better], c[near[better]]
    return which, best, tried


def _points(batch: pa.RecordBatch, column: str, size: int) -> Iterator[np.ndarray]:
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for a in range(0, len(x), ROWS):
        yield x[a : a + ROWS]


def seeds(rows: DataFrame, keys: list[str], k: int, band: int, size: int, seed: int) -> np.ndarray:
    """k series drawn one after the other, each with a chance in proportion to its squared distance from those before.

    A series' draw is the largest log(u) / weight with u from a hash of its keys, so one maximum per pass draws it.
    """
    u = lambda i: (F.pmod(F.xxhash64(*keys, F.lit(seed + i)), F.lit(2**30)) + 1) / (2**30 + 2)
    first = rows.orderBy(F.desc(u(0)), *keys).select("_x").first()
    if first is None:
        return np.zeros((0, size))
    centres = np.array([first["_x"]])
    for i in range(1, k):
        found = assign(rows, centres, band, size).where("_distance > 1e-9")
        drawn = found.orderBy(F.desc(F.log(u(i)) / F.col("_distance")), *keys).select("_x").first()
        if drawn is None:  # fewer kinds of series than clusters
            break
        centres = np.vstack([centres, [drawn["_x"]]])
    return centres


def assign(rows: DataFrame, centres: np.ndarray, band: int, size: int) -> DataFrame:
    """``rows`` with _cluster, _distance (squared) and _tried."""
    schema = StructType([*rows.schema, *StructType.fromDDL("_cluster int, _distance double, _tried long")])
    names = to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [np.concatenate(c) for c in zip(*(nearest(x, centres, band) for x in _points(batch, "_x", size)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts[0], pa.int32()), pa.array(parts[1]), pa.array(parts[2])], names)

    return rows.mapInArrow(run, schema)


def barycentres(rows: DataFrame, centres: np.ndarray, band: int, size: int) -> tuple[np.ndarray, float]:
    """(centres of the series that are nearest to each, sum of squared distances before). A centre without series stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((2, *centres.shape)), 0.0
        for batch in batches:
            for x in _points(batch, "_x", size) if batch.num_rows else ():
                which, distance, _ = nearest(x, centres, band)
                some += float(distance.sum())
                sums, count = laid(x, warp(x, centres[which], band, moves=True)[1], band)
                np.add.at(total[0], which, sums)
                np.add.at(total[1], which, count)
        values = np.concatenate([total.ravel(), [some]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

    # a fixed order of the terms makes the sum the same on every run
    ordered = F.aggregate(F.sort_array(F.collect_list("v")), F.lit(0.0), lambda a, b: a + b)
    got = rows.select("_x").mapInArrow(run, "i int, v double").groupBy("i").agg(ordered.alias("v")).collect()
    values = np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])
    if not len(values):
        return centres, 0.0
    sums, count = values[:-1].reshape(2, *centres.shape)
    return np.where(count > 0, sums / np.maximum(count, 1), centres), float(values[-1])


def elastic_clusters(panel: DataFrame, keys: list[str], k: int, band: int, size: int | None = None, rounds: int = 10, seed: int = 1, tries: int = 3):
    """(keys…, cluster, distance, tried; centres). ``tried`` counts the centres that a series was warped to.

    Of ``tries`` draws of first centres the one with the least total distance stays. Rounds end when
    the total falls by less than a thousandth. ``panel`` is dense; series of another length than
    ``size`` (by default the longest) are drawn out to it. Constant series are zero everywhere.
    """
    series = series_rows(panel, keys)
    size = size or series.agg(F.max(F.size("_y"))).first()[0] or 1
    rows = map_series(series, "_x array<double>", lambda y: {"_x": standard(np.nan_to_num(y), size).tolist()})
    rows = durable(rows.select(*keys, "_x"))
    best = None
    for t in range(tries):
        centres, before = seeds(rows, keys, k, band, size, seed + 1000 * t), np.inf
        if not len(centres):
            break
        for _ in range(rounds):
            moved, total = barycentres(rows, centres, band, size)
            if total > before * (1 - 1e-3):
                break
            centres, before = moved, total
        if best is None or before < best[0]:
            best = before, centres
    if best is None:
        return rows.select(*keys, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("tried")), np.zeros((0, size))
    out = assign(rows, best[1], band, size)
    return out.select(*keys, F.col("_cluster").alias("cluster"), F.sqrt("_distance").alias("distance"), F.col("_tried").alias("tried")), best[1]
