"""Rates of sparse and new items, drawn to the rate of their group as far as their own history is thin.

A group's items have rates that scatter round a mean; an item's own mean scatters round its rate. With
the two variances the best linear estimate is a blend (Bühlmann & Straub 1970), and for counts with a
gamma prior it is the posterior mean. All that is needed of a group are a few sums, so groups of any
size are added up before they are shuffled, and items without any history get the mean of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_col, ratio, shift_period

NOISE = ("poisson", "pooled")


def item_sums(panel: DataFrame, keys: list[str]) -> DataFrame:
    """keys…, n (periods), y (demand), yy (squares) of a dense panel."""
    q = F.col("qty")
    return panel.groupBy(*keys).agg(F.count("qty").alias("n"), F.coalesce(F.sum(q), F.lit(0.0)).alias("y"), F.coalesce(F.sum(q * q), F.lit(0.0)).alias("yy"))


def group_priors(sums: DataFrame, group: list[str], noise: str = "poisson") -> DataFrame:
    """group…, items, mean, within and between: the prior of each group from its items.

    ``within`` is the variance of one period round an item's rate: the mean itself for counts
    (``poisson``), or what the items' own periods show (``pooled``). ``between`` is the variance of the
    rates, what is left of their scatter when the noise is taken off, and never below 0.
    """
    if noise not in NOISE:
        raise ValueError(f"noise must be one of {NOISE}")
    some = sums.where("n > 0")
    rate = F.col("y") / F.col("n")
    t = some.groupBy(*group).agg(
        F.count("*").alias("items"), F.sum("n").alias("_n"), F.sum("y").alias("_y"), F.sum(F.col("n") * F.col("n")).alias("_nn"),
        F.sum(F.col("y") * rate).alias("_yr"), F.sum(F.col("yy") - F.col("y") * rate).alias("_w"),
    )
    mean = F.col("_y") / F.col("_n")
    within = mean if noise == "poisson" else F.coalesce(ratio("_w", F.col("_n") - F.col("items")), F.lit(0.0))
    t = t.withColumns({"mean": mean, "within": F.greatest(within, F.lit(0.0))})
    # the scatter of the rates, weighted by periods, is expected to be (items - 1) within + (n - nn / n) between
    scatter = F.col("_yr") - F.col("_y") * F.col("mean")
    left = ratio(scatter - (F.col("items") - 1) * F.col("within"), F.col("_n") - F.col("_nn") / F.col("_n"))
    between = F.greatest(F.coalesce(left, F.lit(0.0)), F.lit(0.0))
    return t.select(*group, "items", "mean", "within", between.alias("between"))


def pooled_rates(items: DataFrame, panel: DataFrame, keys: list[str], group: list[str], noise: str = "poisson") -> DataFrame:
    """keys…, group…, n, own (the item's mean, null without history), prior, weight, rate.

    ``items`` lists all items with their groups, those without history too. ``weight`` is that of the
    item's own mean: n / (n + within / between). A group without any history takes the mean of all.
    """
    known = items.select(*keys, *group).join(item_sums(panel, keys), keys, "left").fillna(0, ["n", "y", "yy"])
    priors = group_priors(known, group, noise)
    every = F.struct(*[F.col(c) for c in ("mean", "within", "between")])
    overall = group_priors(known.withColumn("_all", F.lit(0)), ["_all"], noise).select(every.alias("o")).agg(F.first("o")).scalar()
    named = priors.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], every.alias("_p"))
    on = None
    for i, g in enumerate(group):
        same = F.col(g).eqNullSafe(F.col(f"_g{i}"))
        on = same if on is None else on & same
    rows = known.join(named, on, "left").withColumn("_p", F.coalesce("_p", overall))
    own = ratio("y", "n")
    part = lambda c: F.col(f"_p.{c}")
    # without noise every history counts in full, without spread none does
    weight = F.when(F.col("n") == 0, 0.0).when(part("between") == 0, F.when(part("within") == 0, 1.0).otherwise(0.0)).otherwise(
        F.col("n") / (F.col("n") + part("within") / part("between"))
    )
    rows = rows.withColumns({"own": own, "prior": part("mean"), "weight": weight})
    blend = F.col("weight") * F.coalesce("own", F.lit(0.0)) + (1 - F.col("weight")) * F.coalesce("prior", F.lit(0.0))
    return rows.select(*keys, *group, F.col("n").cast("long").alias("n"), "own", "prior", "weight", blend.alias("rate"))


def forecast_pooled(
    items: DataFrame, panel: DataFrame, keys: list[str], group: list[str], freq: str, origin, H: int, recent: int | None = None, noise: str = "poisson", name: str = "pooled"
) -> DataFrame:
    """A forecast frame with a row per item and step: the pooled rate of what is known at ``origin``, of the last ``recent`` periods if given."""
    at = as_col(origin)
    known = panel.where(F.col("period") <= at)
    if recent:
        known = known.where(F.col("period") > shift_period(at, -recent, freq))
    rows = pooled_rates(items, known, keys, group, noise).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(H))))
    period: Column = shift_period(at, F.col("h"), freq)
    return rows.select(*keys, at.alias("origin"), F.lit(name).alias("model"), "h", period.alias("period"), F.col("rate").alias("yhat"))
