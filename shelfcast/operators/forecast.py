"""Classical forecasts and rolling backtests.

Forecast frame: keys…, origin (last known period), model, h, period (= origin + h), yhat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import as_col, period_index, shift_period
from ..functions.ranks import exact_quantiles
from ..functions.series import Forecaster
from .score import score


def forecast(
    panel: DataFrame,
    keys: list[str],
    freq: str,
    origins: list,
    H: int,
    models: dict[str, Forecaster],
    actuals: bool = False,
) -> DataFrame:
    """Forecasts of all models from all origins in one pass.

    ``panel`` must be dense. Each series becomes one array (one element per period, so bounded by the
    calendar) in a single shuffle; origins and models are expanded inside the row. With ``actuals`` the
    column qty holds what came true (null if not known), read from the same array, so that scoring
    needs no join. A model whose history is too short gives no rows.
    """
    ordered = F.sort_array(F.collect_list(F.struct("period", F.col("qty").alias("y"))))
    series = panel.groupBy(*keys).agg(F.min("period").alias("_first"), F.transform(ordered, lambda p: p["y"]).alias("_all"))
    at = series.withColumn("origin", F.explode(F.array(*[as_col(o) for o in origins])))
    n = period_index("origin", freq) - period_index("_first", freq) + 1
    at = at.withColumn("_n", F.greatest(F.lit(0), F.least(n, F.size("_all"))))
    at = at.withColumn("_y", F.slice("_all", F.lit(1), F.col("_n")))
    folds = {m.fold: m.state(F.col("_y")) for m in models.values() if m.fold}
    at = at.withColumns({f"_s_{i}": c for i, c in enumerate(folds.values())}) if folds else at
    states = {fold: F.col(f"_s_{i}") for i, fold in enumerate(folds)} | {None: F.col("_y")}

    def rows(name: str, m: Forecaster) -> Column:
        def one(v: Column, i: Column) -> Column:
            came = [F.get("_all", F.col("_n") + i).alias("qty")] if actuals else []
            return F.struct(F.lit(name).alias("model"), (i + 1).alias("h"), v.alias("yhat"), *came)

        return F.transform(F.coalesce(m.project(F.col("_y"), states[m.fold], H), F.array().cast("array<double>")), one)

    out = at.select(*keys, "origin", F.inline(F.flatten(F.array(*[rows(name, m) for name, m in models.items()]))))
    extra = ["qty"] if actuals else []
    return out.select(
        *keys, "origin", "model", "h", shift_period("origin", F.col("h"), freq).alias("period"), "yhat", *extra
    )


def backtest(
    panel: DataFrame,
    keys: list[str],
    freq: str,
    origins: list,
    H: int,
    models: dict[str, Forecaster],
    by: list[str] | None = None,
) -> DataFrame:
    """Rolling-origin scores, by default per model, origin and h."""
    return score(forecast(panel, keys, freq, origins, H, models, actuals=True), keys, by or ["model", "origin", "h"])


def residuals(fc: DataFrame) -> DataFrame:
    """Rows of a forecast made with actuals, with ``residual`` = qty − yhat."""
    return fc.where(F.col("qty").isNotNull()).withColumn("residual", F.col("qty") - F.col("yhat"))


def intervals(
    fc: DataFrame, resid: DataFrame, group: list[str], lo: float = 0.1, hi: float = 0.9
) -> DataFrame:
    """lo and hi = yhat + quantiles of past residuals of the same group (for example model and h)."""
    q = exact_quantiles(resid, group, "residual", {"_lo": lo, "_hi": hi}).drop("n_rows")
    return (
        fc.join(q, group, "left")
        .withColumns({"lo": F.col("yhat") + F.col("_lo"), "hi": F.col("yhat") + F.col("_hi")})
        .drop("_lo", "_hi")
    )


def tune(
    panel: DataFrame, keys: list[str], freq: str, origins: list, H: int, grid: dict[str, Forecaster], metric: str = "rmse"
) -> DataFrame:
    """Grid candidates scored on time-ordered folds, best first (rank 1)."""
    s = backtest(panel, keys, freq, origins, H, grid, by=["model"]).select("model", "n", metric)
    best_first = W.orderBy(F.round(metric, 9).asc_nulls_last(), "model")  # one row per candidate
    return s.withColumn("rank", F.row_number().over(best_first))
