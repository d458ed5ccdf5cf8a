"""Smoothing with fitted parameters."""

from __future__ import annotations

from ..operators import smooth as S
from .base import KEYS, PANEL
from .q_features import qty_panel
from .q_forecast import H, ORIGIN
from .q_hybrid import ITEM, item_panel
from .registry import query

GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


@query("smoothing_against_grid", PANEL + """,
y AS (SELECT p_brand, c_nationkey, list(qty ORDER BY period) AS y FROM panel WHERE period <= DATE '2001-01-01' GROUP BY ALL),
e AS (
  SELECT p_brand, c_nationkey, len(y) AS n, a AS alpha, list_reduce(
    list_prepend({'l': y[1], 'e': 0.0::DOUBLE, 'i': 0}, list_transform(y[2:], lambda v, i: {'l': v, 'e': 0.0::DOUBLE, 'i': i})),
    lambda s, x: {'l': s.l + a * (x.l - s.l), 'e': s.e + CASE WHEN x.i >= 2 THEN (x.l - s.l) * (x.l - s.l) ELSE 0 END, 'i': x.i}).e AS e
  FROM y, (SELECT unnest(""" + str(GRID) + """::DOUBLE[]) AS a)),
m AS (SELECT *, min(e) OVER (PARTITION BY p_brand, c_nationkey) AS least FROM e)
SELECT p_brand, c_nationkey, min(alpha) AS alpha, CASE WHEN min(e) > 0 THEN ln(min(e) / (any_value(n) - 2)) END AS log_mse, true AS not_worse
FROM m WHERE e <= least * (1 + 1e-9) GROUP BY ALL""", rounded="log_mse")
def _(spark, sf):
    return S.against_grid(qty_panel(spark, sf), KEYS, ORIGIN, GRID)


@query("smoothing_models", rounded="alpha beta phi gamma aicc mse", digits=4)
def _(spark, sf):
    return S.smoothing_models(qty_panel(spark, sf), KEYS, ORIGIN, H).drop("yhat")


@query("fc_fitted", rounded="yhat", digits=4)
def _(spark, sf):
    return S.forecast_fitted(qty_panel(spark, sf), KEYS, "month", ORIGIN, H)


@query("fc_fitted_items", rounded="yhat", digits=4)
def _(spark, sf):
    """The kinds without a season: an item sells in a few months of a year."""
    return S.forecast_fitted(item_panel(spark, sf), ITEM, "month", ORIGIN, H, kinds=["level", "trend", "damped"])
