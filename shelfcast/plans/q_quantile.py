"""Quantile forecasts, conformal intervals and the temporal network."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.runtime import durable
from ..operators import learn as L, quantile as Q, temporal as T
from .base import KEYS
from .q_features import qty_panel
from .q_forecast import H, ORIGIN
from .q_models import LOOK
from .registry import query

KNOWN = dt.date(2000, 1, 1)  # first target that training does not see
LEVELS = [0.1, 0.5, 0.9]


def trained(windows, look, **fit):
    windows = durable(windows)
    model = Q.fit_quantiles(windows.where(F.col("period") < F.lit(KNOWN)), LEVELS, look, **fit)
    later = Q.predict_quantiles(windows.where(F.col("period") >= F.lit(KNOWN)), model)
    return durable(later.select(*KEYS, "period", F.col("target").cast("double").alias("y"), *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("lo", "mid", "hi"))]))


@query("quantile_forecast", rounded="lo mid hi shift lo_c hi_c", digits=3)
def _(spark, sf):
    rows = trained(L.windows(qty_panel(spark, sf), KEYS, LOOK), LOOK, epochs=60)
    return Q.conformal(rows, [], "period")


@query("planted_quantiles", """
SELECT unnest(['lo', 'mid', 'hi', 'between', 'conformal']) AS part, true AS within_two_points""")
def _(spark, sf):
    # demand that is evenly spread from 20 to 120, whatever came before
    even = 20 + F.pmod(F.xxhash64(*KEYS, "period"), F.lit(10_000)) / 100
    p = qty_panel(spark, sf).withColumn("qty", even)
    rows = Q.conformal(trained(L.windows(p, KEYS, 4), 4), [], "period")
    share = lambda c: F.avg(c.cast("double"))
    below = lambda c: F.col("y") <= F.col(c)
    inside = lambda lo, hi: F.col("y").between(F.col(lo), F.col(hi))
    parts = {"lo": (below("lo"), 0.1), "mid": (below("mid"), 0.5), "hi": (below("hi"), 0.9), "between": (inside("lo", "hi"), 0.8), "conformal": (inside("lo_c", "hi_c"), 0.8)}
    told = rows.agg(*[(F.abs(share(c) - x) < 0.02).alias(n) for n, (c, x) in parts.items()])
    return told.select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("within_two_points")) for n in parts])))


@query("tcn_forecast", rounded="yhat", digits=3)
def _(spark, sf):
    return T.forecast_tcn(qty_panel(spark, sf), KEYS, "month", ORIGIN, H, 24, epochs=10)
