"""Classical forecasts, scores, backtests and intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.runtime import durable
from ..operators import forecast as FC
from ..operators.score import naive_scale, score
from .base import KEYS, PANEL
from .q_features import qty_panel
from .registry import query

H = 6
ORIGIN = dt.date(2001, 1, 1)
FOLDS = [dt.date(1999, 7, 1), dt.date(2000, 1, 1), dt.date(2000, 7, 1)]
MODELS = {
    "naive": S.naive(),
    "snaive": S.naive(12),
    "ma": S.moving_average(6),
    "ses": S.ses(0.3),
    "croston": S.croston(0.1),
    "sba": S.croston(0.1, "sba"),
}

# ---- oracle text: the same forecasts from list functions ---------------------------------------

_LAST = {
    "naive": "y[n]",
    "snaive": "y[n - 12 + 1 + (h - 1) % 12]",
    "ma": "list_sum(y[greatest(n - 5, 1):n]) / least(n, 6)",
    "ses": "list_reduce(y, lambda a, x: 0.3 * x + 0.7 * a)",
    "croston": "coalesce(cro.z / cro.p, 0.0)",
    "sba": "coalesce(cro.z / cro.p * 0.95, 0.0)",
}
_CROSTON = """list_reduce(list_prepend({'z': NULL::DOUBLE, 'p': NULL::DOUBLE, 's': 1.0::DOUBLE},
      list_transform(y, lambda v: {'z': v, 'p': NULL::DOUBLE, 's': NULL::DOUBLE})),
    lambda a, b: CASE WHEN b.z > 0
      THEN {'z': coalesce(0.1 * b.z + 0.9 * a.z, b.z), 'p': coalesce(0.1 * a.s + 0.9 * a.p, a.s), 's': 1.0::DOUBLE}
      ELSE {'z': a.z, 'p': a.p, 's': a.s + 1.0} END)"""


def dates_sql(origins) -> str:
    return ", ".join(f"(DATE '{o.isoformat()}')" for o in origins)


def hist_sql(origins, keys: str = "p_brand, c_nationkey") -> str:
    return f"""hist AS (
  SELECT {keys}, origin, list(qty ORDER BY period) AS y, count(*) AS n
  FROM panel JOIN (VALUES {dates_sql(origins)}) AS o(origin) ON period <= origin GROUP BY ALL),
state AS (SELECT *, {_CROSTON} AS cro FROM hist)"""


def fc_sql(origins, models=tuple(MODELS), name: str = "fc", keys: str = "p_brand, c_nationkey") -> str:
    parts = "\n  UNION ALL ".join(
        f"SELECT {keys}, origin, '{m}' AS model, CAST(h AS INTEGER) AS h, CAST(origin + to_months(CAST(h AS INTEGER)) AS DATE) AS period, "
        f"CAST({_LAST[m]} AS DOUBLE) AS yhat FROM state, range(1, {H + 1}) AS r(h)"
        for m in models
    )
    return f"{hist_sql(origins, keys)},\n{name} AS (\n  {parts})"


def score_sql(by: str, fc: str = "fc", scale: bool = False, name: str = "scored", extra: str = "") -> str:
    mase = ", avg(abs(yhat - qty) / nullif(scale, 0)) AS mase" if scale else ""
    join = "LEFT JOIN scale USING (p_brand, c_nationkey)" if scale else ""
    return f"""{name} AS (
  SELECT {by}, count(*) AS n, avg(abs(yhat - qty)) AS mae, sqrt(avg(power(yhat - qty, 2))) AS rmse,
         sum(abs(yhat - qty)) / nullif(sum(abs(qty)), 0) AS wape,
         avg(2 * abs(yhat - qty) / nullif(abs(qty) + abs(yhat), 0)) AS smape, avg(yhat - qty) AS bias,
         sqrt(avg(power(ln(1 + greatest(yhat, 0)) - ln(1 + greatest(qty, 0)), 2))) AS rmsle{mase}
  FROM {fc} JOIN panel USING (p_brand, c_nationkey, period) {extra} {join} GROUP BY ALL)"""


SCALE_SQL = """scale AS (
  SELECT p_brand, c_nationkey, avg(d) AS scale FROM (
    SELECT p_brand, c_nationkey, abs(qty - lag(qty, 12) OVER (PARTITION BY p_brand, c_nationkey ORDER BY period)) AS d
    FROM panel WHERE period <= DATE '2001-01-01') GROUP BY ALL)"""
METRIC_COLS = "mae rmse wape smape bias rmsle"


def run(spark, sf, origins, models):
    return FC.forecast(qty_panel(spark, sf), KEYS, "month", origins, H, {m: MODELS[m] for m in models})


@query("fc_naive", PANEL + f", {fc_sql([ORIGIN], ['naive', 'snaive'])} SELECT * FROM fc")
def _(spark, sf):
    return run(spark, sf, [ORIGIN], ["naive", "snaive"])


@query("fc_moving_average", PANEL + f", {fc_sql([ORIGIN], ['ma'])} SELECT * FROM fc", rounded="yhat")
def _(spark, sf):
    return run(spark, sf, [ORIGIN], ["ma"])


@query("fc_ses", PANEL + f", {fc_sql([ORIGIN], ['ses'])} SELECT * FROM fc", rounded="yhat")
def _(spark, sf):
    return run(spark, sf, [ORIGIN], ["ses"])


@query("fc_holt_winters", PANEL + f""", {hist_sql([ORIGIN])},
init AS (
  SELECT p_brand, c_nationkey, origin, y, list_avg(y[1:12]) AS m1, list_avg(y[13:24]) AS m2 FROM hist WHERE n >= 24),
ends AS (
  SELECT *, list_reduce(
    list_prepend({{'x': NULL::DOUBLE, 'l': m1, 'b': (m2 - m1) / 12, 's': list_transform(y[1:12], lambda v: v - m1)}},
      list_transform(y[13:], lambda v: {{'x': v, 'l': NULL::DOUBLE, 'b': NULL::DOUBLE, 's': NULL::DOUBLE[]}})),
    lambda a, c: {{'x': NULL::DOUBLE,
      'l': 0.3 * (c.x - a.s[1]) + 0.7 * (a.l + a.b),
      'b': 0.1 * (0.3 * (c.x - a.s[1]) + 0.7 * (a.l + a.b) - a.l) + 0.9 * a.b,
      's': list_append(a.s[2:12], 0.2 * (c.x - (0.3 * (c.x - a.s[1]) + 0.7 * (a.l + a.b))) + 0.8 * a.s[1])}}) AS e
  FROM init)
SELECT p_brand, c_nationkey, origin, 'holt_winters' AS model, CAST(h AS INTEGER) AS h,
       CAST(origin + to_months(CAST(h AS INTEGER)) AS DATE) AS period, e.l + h * e.b + e.s[(h - 1) % 12 + 1] AS yhat
FROM ends, range(1, {H + 1}) AS r(h)""", rounded="yhat")
def _(spark, sf):
    hw = {"holt_winters": S.holt_winters(12, 0.3, 0.1, 0.2)}
    return FC.forecast(qty_panel(spark, sf), KEYS, "month", [ORIGIN], H, hw)


@query("fc_croston", PANEL + f""", {fc_sql([ORIGIN], ['croston', 'sba'])},
tsb AS (
  SELECT p_brand, c_nationkey, origin, list_reduce(list_prepend({{'z': NULL::DOUBLE, 'p': NULL::DOUBLE, 's': 1.0::DOUBLE}},
      list_transform(y, lambda v: {{'z': v, 'p': NULL::DOUBLE, 's': NULL::DOUBLE}})),
    lambda a, b: CASE WHEN b.z > 0
      THEN {{'z': coalesce(0.1 * b.z + 0.9 * a.z, b.z), 'p': coalesce(a.p + 0.1 * (1 - a.p), 1 / a.s), 's': a.s + 1.0}}
      ELSE {{'z': a.z, 'p': a.p * 0.9, 's': a.s + 1.0}} END) AS t FROM hist)
SELECT * FROM fc UNION ALL
SELECT p_brand, c_nationkey, origin, 'tsb', CAST(h AS INTEGER), CAST(origin + to_months(CAST(h AS INTEGER)) AS DATE),
       coalesce(t.z * t.p, 0.0) FROM tsb, range(1, {H + 1}) AS r(h)""", rounded="yhat")
def _(spark, sf):
    models = {"croston": MODELS["croston"], "sba": MODELS["sba"], "tsb": S.croston(0.1, "tsb")}
    return FC.forecast(qty_panel(spark, sf), KEYS, "month", [ORIGIN], H, models)


@query("accuracy_metrics", PANEL + f""", {fc_sql([ORIGIN])}, {SCALE_SQL},
{score_sql('p_brand, c_nationkey, model', scale=True)} SELECT * FROM scored""", rounded=METRIC_COLS + " mase")
def _(spark, sf):
    p = qty_panel(spark, sf)
    fc = FC.forecast(p, KEYS, "month", [ORIGIN], H, MODELS, actuals=True)
    return score(fc, KEYS, [*KEYS, "model"], scale=naive_scale(p, KEYS, ORIGIN, 12))


@query("accuracy_metrics_total", PANEL + f""", {fc_sql([ORIGIN])}, {SCALE_SQL},
{score_sql('model', scale=True)} SELECT * FROM scored""", rounded=METRIC_COLS + " mase")
def _(spark, sf):
    p = qty_panel(spark, sf)
    fc = FC.forecast(p, KEYS, "month", [ORIGIN], H, MODELS)
    return score(fc, KEYS, ["model"], actual=p, scale=naive_scale(p, KEYS, ORIGIN, 12))


@query("rolling_backtest", PANEL + f""", {fc_sql(FOLDS)}, {score_sql('model, origin, h')} SELECT * FROM scored""",
       rounded=METRIC_COLS)
def _(spark, sf):
    return FC.backtest(qty_panel(spark, sf), KEYS, "month", FOLDS, H, MODELS)


GRID = (0.05, 0.1, 0.2, 0.3, 0.5)


@query("tune_time_ordered", PANEL + f""", {hist_sql(FOLDS)}, fc AS (
  {" UNION ALL ".join(
      f"SELECT p_brand, c_nationkey, 'ses_{a}' AS model, CAST(origin + to_months(CAST(h AS INTEGER)) AS DATE) AS period, "
      f"CAST(list_reduce(y, lambda s, x: {a} * x + {1 - a} * s) AS DOUBLE) AS yhat FROM hist, range(1, {H + 1}) AS r(h)"
      for a in GRID)}),
{score_sql('model')}
SELECT model, n, rmse, CAST(row_number() OVER (ORDER BY round(rmse, 9), model) AS INTEGER) AS rank FROM scored""",
       rounded="rmse")
def _(spark, sf):
    grid = {f"ses_{a}": S.ses(a) for a in GRID}
    return FC.tune(qty_panel(spark, sf), KEYS, "month", FOLDS, H, grid)


@query("residual_interval", PANEL + f""", {fc_sql(FOLDS, name="past")}, q AS (
  SELECT model, h, quantile_cont(qty - yhat, 0.1) AS a, quantile_cont(qty - yhat, 0.9) AS b
  FROM past JOIN panel USING (p_brand, c_nationkey, period) GROUP BY ALL),
{fc_sql([ORIGIN]).replace('hist', 'hist2').replace('state', 'state2')}
SELECT fc.*, yhat + a AS lo, yhat + b AS hi FROM fc LEFT JOIN q USING (model, h)""", rounded="yhat lo hi")
def _(spark, sf):
    # all origins in one pass over the sales, stored since the quantiles read the past ones several times
    every = durable(FC.forecast(qty_panel(spark, sf), KEYS, "month", [*FOLDS, ORIGIN], H, MODELS, actuals=True))
    past = FC.residuals(every.where(F.col("origin").isin(FOLDS)))
    return FC.intervals(every.where(F.col("origin") == F.lit(ORIGIN)).drop("qty"), past, ["model", "h"])
