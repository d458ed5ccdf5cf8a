"""Rule-based demand classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_col, period_index, ratio
from ..functions.ranks import running_total
from ..functions.runtime import bounded_rows
from ..functions.vectors import lit_json
from .patterns import adi_cv2

SBC = ["smooth", "erratic", "intermittent", "lumpy", "no_demand"]


def classify_sbc(profile: DataFrame, adi: float = 1.32, cv2: float = 0.49) -> DataFrame:
    """Smooth, erratic, intermittent or lumpy by demand interval and size variation."""
    often, even = F.col("adi") < adi, F.col("cv2") < cv2
    return profile.withColumn(
        "segment",
        F.when(F.col("adi").isNull(), "no_demand")
        .when(often & even, "smooth")
        .when(often, "erratic")
        .when(even, "intermittent")
        .otherwise("lumpy"),
    )


def classify_abc(
    df: DataFrame, keys: list[str], value: str = "revenue", by: list[str] | None = None, cuts: tuple[float, float] = (0.8, 0.95)
) -> DataFrame:
    """A, B, C by the share of ``value`` that larger items of the group already cover.

    ``df`` has one row per item. The ranking is a running total over range partitions, so neither the
    whole table nor a large group is ever in one task. Ties go by key.
    """
    by = by or []
    order = [F.col(value).desc(), *[F.col(k).asc() for k in keys if k not in by]]
    ranked = running_total(df, by, order, value)
    share = ratio("before", "total")
    label = F.when(share < cuts[0], "A").when(share < cuts[1], "B").otherwise("C")
    return ranked.select(*df.columns, share.alias("share_before"), label.alias("abc"))


def classify_xyz(variation: DataFrame, cuts: tuple[float, float] = (0.5, 1.0)) -> DataFrame:
    """X, Y, Z by the coefficient of variation over all periods; no demand at all counts as Z."""
    cv = F.col("cv")
    return variation.withColumn("xyz", F.when(cv < cuts[0], "X").when(cv < cuts[1], "Y").otherwise("Z"))


def abc_xyz(abc: DataFrame, xyz: DataFrame, keys: list[str], value: str = "revenue") -> DataFrame:
    """Nine-cell table in long form: series and value per (abc, xyz)."""
    return (
        abc.join(xyz.select(*keys, "xyz"), keys)
        .groupBy("abc", "xyz")
        .agg(F.count("*").alias("series"), F.sum(value).alias(value))
    )


def lifecycle(panel: DataFrame, keys: list[str], freq: str, asof, new_n: int, dormant_n: int, ended_n: int) -> DataFrame:
    """Stage at ``asof`` from the first and last nonzero period up to then.

    ended: no sale for ended_n periods or more; dormant: for dormant_n or more; new: first sale less
    than new_n periods ago; else active. ``unborn`` has no sale yet.
    """
    t = period_index("period", freq)
    now = period_index(as_col(asof), freq)
    sold = F.when((F.col("qty") > 0) & (F.col("period") <= as_col(asof)), t)
    out = panel.groupBy(*keys).agg((now - F.min(sold)).alias("age"), (now - F.max(sold)).alias("idle"))
    stage = (
        F.when(F.col("age").isNull(), "unborn")
        .when(F.col("idle") >= ended_n, "ended")
        .when(F.col("idle") >= dormant_n, "dormant")
        .when(F.col("age") < new_n, "new")
        .otherwise("active")
    )
    return out.withColumn("stage", stage)


def classify_rules(profile: DataFrame, rules: DataFrame, metrics: list[str], default: str = "unmatched", most: int = 100_000) -> DataFrame:
    """First matching rule by priority gives the label; rules of equal priority go by label.

    A rule row has ``priority``, ``label`` and per metric ``<m>_lo`` (included) and ``<m>_hi`` (excluded);
    a null bound is open. The rules, checked to be at most ``most``, become one literal array, whatever
    their number, so the profile is neither shuffled nor joined and no expression is nested in another.
    """
    rows = sorted(bounded_rows(rules, most, "rule table"), key=lambda r: (r["priority"], r["label"]))
    ends = [f"{m}_{end}" for m in metrics for end in ("lo", "hi")]
    listed = [{"label": r["label"]} | {e: None if r[e] is None else float(r[e]) for e in ends} for r in rows]
    table = lit_json(listed, f"array<struct<label: string, {', '.join(f'`{e}`: double' for e in ends)}>>")

    def matches(r: Column) -> Column:
        hit = F.lit(True)
        for m in metrics:
            lo, hi = r[f"{m}_lo"], r[f"{m}_hi"]
            hit = hit & (lo.isNull() | F.coalesce(F.col(m) >= lo, F.lit(False))) & (hi.isNull() | F.coalesce(F.col(m) < hi, F.lit(False)))
        return hit

    return profile.withColumn("label", F.coalesce(F.get(F.filter(table, matches), F.lit(0))["label"], F.lit(default)))


def transitions(panel: DataFrame, keys: list[str], cut) -> DataFrame:
    """Number of series by class before ``cut`` and class from ``cut`` on."""
    halves = panel.withColumn("_win", F.when(F.col("period") < as_col(cut), 1).otherwise(2))
    classes = classify_sbc(adi_cv2(halves, [*keys, "_win"]))
    pick = lambda n: F.max(F.when(F.col("_win") == n, F.col("segment")))
    return (
        classes.groupBy(*keys)
        .agg(pick(1).alias("from_segment"), pick(2).alias("to_segment"))
        .groupBy("from_segment", "to_segment")
        .agg(F.count("*").alias("series"))
    )
