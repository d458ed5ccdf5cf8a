"""Level shifts: the segmentation of a series into stretches of one level, with a penalty per stretch.

The best segmentation minimises the squared distance from each stretch's mean plus a penalty per
stretch. A dynamic program over the last change finds it exactly; changes that can no longer be the
last one are dropped on the way (Killick, Fearnhead & Eckley 2012). Series of one length are worked on
together, and a change is dropped once it is ruled out for all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import shift_period
from ..functions.rows import map_series, series_rows


def noise_variance(y: np.ndarray) -> np.ndarray:
    """Half the mean squared change from one period to the next: shifts of level hardly add to it."""
    d = np.diff(y, axis=1)
    return (d * d).sum(axis=1) / (2 * max(1, d.shape[1]))


def last_changes(y: np.ndarray, penalty: np.ndarray, least: int, prune: bool = True) -> tuple[np.ndarray, int]:
    """(where the last stretch of the best segmentation of the first t values begins, for every t; changes looked at)."""
    n, size = y.shape
    zero = np.zeros((n, 1))
    s1, s2 = (np.hstack([zero, np.cumsum(v, axis=1)]) for v in (y, y * y))
    best = np.full((n, size + 1), np.inf)
    best[:, 0] = 0
    begin = np.zeros((n, size + 1), "int64")
    alive, out_since, ruled_out, seen = [0], {}, np.zeros((n, size + 1), bool), 0
    for t in range(least, size + 1):
        if t - least >= least:
            alive.append(t - least)
        at = np.array(alive)
        seen += len(at)
        step = s1[:, t : t + 1] - s1[:, at]
        cost = (s2[:, t : t + 1] - s2[:, at]) - step * step / (t - at)
        total = best[:, at] + cost + penalty[:, None]
        first = total.argmin(axis=1)  # of equal ones the earliest
        best[:, t], begin[:, t] = total[np.arange(n), first], at[first]
        if prune:
            # what costs more than the best up to t, even without a penalty, is worse for every end that leaves room behind t
            slack = 1e-9 * (1 + np.abs(best[:, t : t + 1]))
            ruled_out[:, at] |= best[:, at] + cost > best[:, t : t + 1] + slack
            for s in at[ruled_out[:, at].all(axis=0)]:
                out_since.setdefault(int(s), t)
            alive = [s for s in alive if out_since.get(s, size + 1) > t + 1 - least]
    return begin, seen


def stretches(begin: np.ndarray, size: int) -> list[list[int]]:
    """Ends of all stretches of each series, in order."""
    out = []
    for row in begin:
        ends, t = [], size
        while t > 0:
            ends.append(int(t))
            t = row[t]
        out.append(ends[::-1])
    return out


def level_shifts(panel: DataFrame, keys: list[str], freq: str, least: int = 3, penalty: float = 2.0) -> DataFrame:
    """keys…, segment (from 1), start, end (periods), n, level and shift (change from the level before, null for the first).

    ``penalty`` is in units of the noise variance times the log of the length; a stretch has ``least``
    periods or more. A series shorter than that is one stretch. ``panel`` is dense.
    """

    def compute(y: np.ndarray) -> dict[str, list]:
        size = y.shape[1]
        if size < 2 * least:
            return {"_ends": [[size]] * len(y)}
        return {"_ends": stretches(last_changes(y, penalty * noise_variance(y) * np.log(size), least)[0], size)}

    rows = map_series(series_rows(panel, keys), "_ends array<int>", compute)
    level = lambda a, b: F.aggregate(F.slice("_y", a + 1, b - a), F.lit(0.0), lambda t, v: t + v) / (b - a)
    begin = lambda i: F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)
    each = F.transform("_ends", lambda end, i: F.struct((i + 1).alias("segment"), begin(i).alias("a"), end.alias("b"), level(begin(i), end).alias("level")))
    rows = rows.withColumn("_s", each)
    out = rows.select(*keys, "_first", "_s", F.explode("_s").alias("_e"))
    before = F.get("_s", F.col("_e.segment") - 2)["level"]
    return out.select(
        *keys, F.col("_e.segment").alias("segment"), shift_period("_first", F.col("_e.a"), freq).alias("start"),
        shift_period("_first", F.col("_e.b") - 1, freq).alias("end"), (F.col("_e.b") - F.col("_e.a")).cast("long").alias("n"),
        F.col("_e.level").alias("level"), (F.col("_e.level") - before).alias("shift"),
    )
