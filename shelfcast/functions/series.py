"""Forecasters as expressions over one series' history array.

``y`` is an ``array<double>`` column: the dense history in time order, one element per period. A
forecaster first folds the history into a small state, then projects the state H steps; forecasters
with the same state (named by ``fold``) share the fold. A projection is an ``array<double>`` of H
values, or null where the history is too short. All of it runs inside the JVM, and any number of
forecasters share one pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Forecaster:
    project: Callable[[Column, Column, int], Column]  # (history, state, H) → array of H values
    fold: str | None = None  # name of the state, None when the history itself is enough
    state: Callable[[Column], Column] | None = None

    def __call__(self, y: Column, H: int) -> Column:
        return self.project(y, self.state(y) if self.state else y, H)


def _last(y: Column, n: int) -> Column:
    """The last n elements; needs size(y) ≥ n."""
    return F.slice(y, -n, n)


def _after_first(y: Column, n: int) -> Column:
    return F.slice(y, n + 1, F.greatest(F.size(y) - n, F.lit(0)))


def _flat(value: Column, H: int) -> Column:
    return F.when(value.isNotNull(), F.array_repeat(value, H))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def naive(m: int = 1) -> Forecaster:
    """The last value, or with m > 1 the last season repeated."""

    def project(y: Column, _, H: int) -> Column:
        season = F.flatten(F.array_repeat(_last(y, m), -(-H // m)))
        return F.when(F.size(y) >= m, F.slice(season, 1, H))

    return Forecaster(project)


def moving_average(n: int) -> Forecaster:
    """Mean of the last n values, or of all when there are fewer."""

    def project(y: Column, _, H: int) -> Column:
        have = F.least(F.size(y), F.lit(n))
        tail = F.when(F.size(y) > n, _last(y, n)).otherwise(y)
        return _flat(F.when(have > 0, _sum(tail) / have), H)

    return Forecaster(project)


def ses_level(y: Column, alpha: float) -> Column:
    """Smoothed level, started at the first value."""
    return F.aggregate(_after_first(y, 1), F.get(y, F.lit(0)), lambda level, x: alpha * x + (1 - alpha) * level)


def ses(alpha: float) -> Forecaster:
    return Forecaster(lambda y, level, H: _flat(level, H), f"ses_{alpha}", lambda y: ses_level(y, alpha))


def holt_winters(m: int, alpha: float, beta: float, gamma: float) -> Forecaster:
    """Additive level, trend and season of m periods; needs two seasons.

    The first season gives level and indices, the change of mean to the second one the trend. The
    seasonal indices are a queue: the one in use is in front and goes to the back once updated.
    """

    def step(state: Column, x: Column) -> Column:
        level, trend, season = state["level"], state["trend"], state["season"]
        now = F.get(season, F.lit(0))
        new_level = alpha * (x - now) + (1 - alpha) * (level + trend)
        new_now = gamma * (x - new_level) + (1 - gamma) * now
        return F.struct(
            new_level.alias("level"),
            (beta * (new_level - level) + (1 - beta) * trend).alias("trend"),
            F.concat(F.slice(season, 2, m - 1), F.array(new_now)).alias("season"),
        )

    def fold(y: Column) -> Column:
        mean1 = _sum(F.slice(y, 1, m)) / m
        mean2 = _sum(F.slice(y, m + 1, m)) / m
        start = F.struct(
            mean1.alias("level"),
            ((mean2 - mean1) / m).alias("trend"),
            F.transform(F.slice(y, 1, m), lambda v: v - mean1).alias("season"),
        )
        return F.when(F.size(y) >= 2 * m, F.aggregate(_after_first(y, m), start, step))

    def project(y: Column, end: Column, H: int) -> Column:
        ahead = F.transform(
            F.sequence(F.lit(0), F.lit(H - 1)),
            lambda i: end["level"] + (i + 1) * end["trend"] + F.get(end["season"], i % m),
        )
        return F.when(end.isNotNull(), ahead)

    return Forecaster(project, f"hw_{m}_{alpha}_{beta}_{gamma}", fold)


def croston(alpha: float, variant: str = "croston") -> Forecaster:
    """Intermittent demand: 'croston' (1972), 'sba' (× (1 − α/2)) or 'tsb' (demand probability).

    Periods are counted from the first row. No demand at all gives 0.
    """
    if variant not in ("croston", "sba", "tsb"):
        raise ValueError(f"unknown variant {variant!r}")
    # one branch per step: most periods of such a series only count on
    def interval_step(s: Column, x: Column) -> Column:
        blend = lambda new, old: F.coalesce(alpha * new + (1 - alpha) * old, new)
        return F.when(x > 0, F.struct(
            blend(x, s["size"]).alias("size"), blend(s["since"], s["rate"]).alias("rate"), F.lit(1.0).alias("since")
        )).otherwise(F.struct(s["size"].alias("size"), s["rate"].alias("rate"), (s["since"] + 1.0).alias("since")))

    def chance_step(s: Column, x: Column) -> Column:
        since = (s["since"] + 1.0).alias("since")
        up = F.coalesce(s["rate"] + alpha * (1 - s["rate"]), 1 / s["since"])
        return F.when(x > 0, F.struct(
            F.coalesce(alpha * x + (1 - alpha) * s["size"], x).alias("size"), up.alias("rate"), since
        )).otherwise(F.struct(s["size"].alias("size"), (s["rate"] * (1 - alpha)).alias("rate"), since))

    def fold(y: Column) -> Column:
        null = F.lit(None).cast("double")
        start = F.struct(null.alias("size"), null.alias("rate"), F.lit(1.0).alias("since"))
        return F.when(F.size(y) > 0, F.aggregate(y, start, chance_step if variant == "tsb" else interval_step))

    def project(y: Column, end: Column, H: int) -> Column:
        if variant == "tsb":
            value = end["size"] * end["rate"]
        else:
            value = end["size"] / end["rate"] * (1 - alpha / 2 if variant == "sba" else 1.0)
        return _flat(F.when(end.isNotNull(), F.coalesce(value, F.lit(0.0))), H)

    return Forecaster(project, f"{'tsb' if variant == 'tsb' else 'croston'}_{alpha}", fold)
