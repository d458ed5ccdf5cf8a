"""Forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_col, ratio
from .panel import by_series

METRICS = ["mae", "rmse", "wape", "smape", "bias", "rmsle"]


def naive_scale(panel: DataFrame, keys: list[str], until, m: int = 1) -> DataFrame:
    """Mean absolute m-step change of each series up to ``until``; the MASE denominator."""
    step = F.abs(F.col("qty") - F.lag("qty", m).over(by_series(keys)))
    known = panel.where(F.col("period") <= as_col(until))
    return known.select(*keys, step.alias("_step")).groupBy(*keys).agg(F.avg("_step").alias("scale"))


def metric_columns() -> dict[str, Column]:
    """Aggregates of yhat against qty; rows without qty or yhat add nothing."""
    y, f = F.col("qty"), F.col("yhat")
    e = F.abs(f - y)
    logs = F.log1p(F.greatest(f, F.lit(0.0))) - F.log1p(F.greatest(y, F.lit(0.0)))
    return {
        "n": F.count("*"),
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg((f - y) * (f - y))),
        "wape": ratio(F.sum(e), F.sum(F.abs(y))),
        "smape": F.avg(ratio(2 * e, F.abs(y) + F.abs(f))),
        "bias": F.avg(f - y),
        # the larger of a null and 0 is 0
        "rmsle": F.sqrt(F.avg(F.when(y.isNotNull() & f.isNotNull(), logs * logs))),
    }


def score(
    fc: DataFrame, keys: list[str], by: list[str], actual: DataFrame | None = None, scale: DataFrame | None = None
) -> DataFrame:
    """MAE, RMSE, WAPE, sMAPE, bias (forecast − actual), RMSLE and with ``scale`` MASE per group.

    ``fc`` carries the actual as qty, or ``actual`` is joined. A zero denominator gives null: the row is
    left out of sMAPE and MASE, WAPE is null for the group.
    """
    rows = fc.where(F.col("qty").isNotNull()) if actual is None else fc.join(actual.select(*keys, "period", "qty"), [*keys, "period"])
    if scale is not None:
        rows = rows.join(scale, keys, "left")
    aggs = metric_columns()
    if scale is not None:
        aggs["mase"] = F.avg(ratio(F.abs(F.col("yhat") - F.col("qty")), "scale"))
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
