"""Demand pattern analysis: per-series statistics, correlation, trend and season.

A series has one row per period, so exact quantiles and per-series windows are over bounded groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import period_index, ratio
from .panel import by_series


def profile(panel: DataFrame, keys: list[str]) -> DataFrame:
    """n, zero share, mean, sd, min, quartiles, max, first and last period of each series."""
    quart = F.percentile("qty", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = panel.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.col("qty") == 0).cast("double")).alias("zero_share"),
        F.avg("qty").alias("mean"),
        F.stddev_samp("qty").alias("sd"),
        F.min("qty").alias("min"),
        quart.alias("_q"),
        F.max("qty").alias("max"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
    )
    cols = {"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]}
    return out.withColumns(cols).drop("_q")


def _cv2(y: Column) -> Column:
    """Population variance over squared mean, as n·Σy²/(Σy)² − 1: for whole quantities both sums are
    exact, so the order of rows cannot move a series across a class border."""
    total = F.sum(y)
    spread = ratio(F.count(y) * F.sum(y * y), total * total) - 1
    return F.when(spread < 0, 0.0).otherwise(spread)  # null without demand


def adi_cv2(panel: DataFrame, keys: list[str], n_periods=None) -> DataFrame:
    """Average demand interval and squared variation of nonzero sizes.

    ADI = periods / nonzero periods. On a sparse panel give ``n_periods`` (a number or column), so that
    periods without a row count and need not be made.
    """
    y = F.when(F.col("qty") > 0, F.col("qty"))
    n = F.count("*") if n_periods is None else F.lit(n_periods) if isinstance(n_periods, int) else n_periods
    out = panel.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.count(y).alias("nonzero"),
        F.avg(y).alias("mean_size"),
        _cv2(y).alias("cv2"),
    )
    out = out.withColumn("n", (F.col("_rows") if n_periods is None else n).cast("long"))
    return out.select(
        *keys,
        "n",
        "nonzero",
        "mean_size",
        ratio("n", "nonzero").alias("adi"),
        "cv2",
    )


def variation(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficient of variation over all periods, and total demand."""
    return panel.groupBy(*keys).agg(
        F.sum("qty").alias("qty"), ratio(F.stddev_pop("qty"), F.avg("qty")).alias("cv")
    )


def intervals(panel: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """How often each gap (in periods) between nonzero periods occurs in a series."""
    t = period_index("period", freq)
    sold = panel.where(F.col("qty") > 0)
    gaps = sold.select(*keys, (t - F.lag(t).over(by_series(keys))).alias("gap")).where(F.col("gap").isNotNull())
    return gaps.groupBy(*keys, "gap").agg(F.count("*").alias("times"))


def acf(panel: DataFrame, keys: list[str], K: int) -> DataFrame:
    """Autocorrelation of lags 1…K in long form; null for a constant series."""
    d = panel.select(*keys, "period", (F.col("qty") - F.avg("qty").over(W.partitionBy(*keys))).alias("_d"))
    w = by_series(keys)
    d = d.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, K + 1)})
    out = d.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        *[F.sum(F.col("_d") * F.col(f"_d{k}")).alias(f"_s{k}") for k in range(1, K + 1)],
    )
    value = lambda k: F.when(F.col("_ss") > 1e-12, F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / F.col("_ss"))
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), value(k).alias("acf")) for k in range(1, K + 1)])
    return out.select(*keys, F.inline(pairs))


def trend(panel: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """Least-squares line of qty on the period number, 0 at the first period of the series.

    One aggregation: the fit is on the calendar index, and the intercept is then moved to the start.
    """
    t = period_index("period", freq)
    out = panel.groupBy(*keys).agg(
        F.regr_slope("qty", t).alias("slope"),
        F.regr_intercept("qty", t).alias("_b"),
        F.regr_r2("qty", t).alias("r2"),
        F.min(t).alias("_t0"),
    )
    return out.select(*keys, "slope", (F.col("_b") + F.col("slope") * F.col("_t0")).alias("intercept"), "r2")


def season_position(freq: str, m: int):
    """Position 0…m−1 in a season of m periods."""
    return F.pmod(period_index("period", freq), F.lit(m))


def decompose(panel: DataFrame, keys: list[str], freq: str, m: int) -> DataFrame:
    """Centred moving-average trend, seasonal index (sums to 0 over a season) and remainder.

    Trend is 2×m for even m and null where the window does not fit. One shuffle by key serves all four
    windows, since (keys, position) groups lie inside key partitions.
    """
    w = by_series(keys)
    half = m // 2
    span = lambda lo, hi: F.avg("qty").over(w.rowsBetween(lo, hi))
    if m % 2:
        ma = span(-half, half)
        ends = F.lag("qty", half).over(w).isNotNull() & F.lead("qty", half).over(w).isNotNull()
    else:
        ma = (span(-half, half - 1) + span(-half + 1, half)) / 2
        ends = F.lag("qty", half).over(w).isNotNull() & F.lead("qty", half).over(w).isNotNull()
    df = panel.withColumns({"trend": F.when(ends, ma), "position": season_position(freq, m)})
    at = W.partitionBy(*keys, "position")
    df = df.withColumns({
        "_raw": F.avg(F.col("qty") - F.col("trend")).over(at),
        "_once": F.row_number().over(at.orderBy("period")) == 1,
    })
    centre = F.avg(F.when(F.col("_once"), F.col("_raw"))).over(W.partitionBy(*keys))
    df = df.withColumn("seasonal", F.col("_raw") - centre)
    return df.withColumn("remainder", F.col("qty") - F.col("trend") - F.col("seasonal")).drop("_raw", "_once")


def strengths(decomposed: DataFrame, keys: list[str]) -> DataFrame:
    """max(0, 1 − var(remainder)/var(remainder + part)) for trend and season."""
    ok = F.col("remainder").isNotNull()
    var = lambda c: F.var_pop(F.when(ok, c))
    r = F.col("remainder")
    strength = lambda part: F.greatest(F.lit(0.0), 1 - ratio(var(r), var(r + F.col(part))))
    return decomposed.groupBy(*keys).agg(strength("trend").alias("trend_strength"), strength("seasonal").alias("seasonal_strength"))


def seasonal_share(df: DataFrame, keys: list[str], unit: str = "month") -> DataFrame:
    """Share of a series' demand by month (1…12) or ISO weekday (1…7), one column each."""
    if unit == "month":
        part, values = F.month("period"), range(1, 13)
    elif unit == "weekday":
        part, values = F.weekday("period") + 1, range(1, 8)
    else:
        raise ValueError("unit must be 'month' or 'weekday'")
    sums = df.groupBy(*keys).agg(
        F.sum("qty").alias("_all"), *[F.sum(F.when(part == v, F.col("qty")).otherwise(0.0)).alias(f"_{v}") for v in values]
    )
    return sums.select(*keys, *[ratio(f"_{v}", "_all").alias(f"{unit}_{v}") for v in values])


def promo_uplift(panel: DataFrame, keys: list[str], at_least: float = 0.5) -> DataFrame:
    """Mean demand in promo periods over mean demand in the others."""
    on = F.col("promo") >= at_least
    out = panel.groupBy(*keys).agg(
        F.count_if(on).alias("promo_periods"),
        F.avg(F.when(on, F.col("qty"))).alias("promo_mean"),
        F.avg(F.when(~on, F.col("qty"))).alias("base_mean"),
    )
    return out.withColumn("uplift", ratio("promo_mean", "base_mean"))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Series counts: rows by ``a``, one column per value of ``b``."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(v) for v in values])


def wide_profile(panel: DataFrame, keys: list[str]) -> DataFrame:
    """All profile numbers that segmentation uses, from one aggregation of a dense panel."""
    y = F.when(F.col("qty") > 0, F.col("qty"))
    return panel.groupBy(*keys).agg(
        ratio(F.count("*"), F.count(y)).alias("adi"),
        _cv2(y).alias("cv2"),
        ratio(F.stddev_pop("qty"), F.avg("qty")).alias("cv"),
        F.avg("qty").alias("mean"),
        F.avg((F.col("qty") == 0).cast("double")).alias("zero_share"),
    )
