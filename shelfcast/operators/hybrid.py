"""Hybrid framework: choose, blend, repair and reconcile forecasts per segment."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import as_col, ratio, shift_period
from ..functions.runtime import durable
from ..functions.series import Forecaster
from .forecast import forecast
from .panel import hierarchy
from .patterns import adi_cv2
from .rules import classify_sbc
from .score import metric_columns


def routed(routing: dict[str, str], other: str | None = None) -> Column:
    """Model of the row's ``segment``; ``other`` for segments that the routing does not name."""
    # the routing table is a short dict: an expression, not a join
    pairs = [F.lit(x) for pair in routing.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("segment")), F.lit(other).cast("string"))


def route(
    segments: DataFrame, routing: dict[str, str], forecasts: DataFrame, keys: list[str], other: str | None = None
) -> DataFrame:
    """Forecast of the model that each series' segment is routed to, for every series, origin and period.

    Where that model has no forecast, or the segment has no model, yhat is null and the row stays, so
    that ``fallback`` can fill it.
    """
    at = ["origin", "period", "h"]
    grid = forecasts.select(*keys, *at).distinct().join(segments.select(*keys, "segment"), keys, "left")
    return grid.withColumn("model", routed(routing, other)).join(
        forecasts.select(*keys, *at, "model", "yhat"), [*keys, *at, "model"], "left"
    )


def best_model(scores: DataFrame, keys: list[str], metric: str = "mae") -> DataFrame:
    """Model with the least error per series; equal errors (to 9 places) go to the first name."""
    rank = F.struct(F.round(metric, 9).alias("e"), F.col("model").alias("m"))
    known = scores.where(F.col(metric).isNotNull())
    return known.groupBy(*keys).agg(F.min(rank).alias("_best")).select(*keys, F.col("_best.m").alias("model"), F.col("_best.e").alias(metric))


def weights(scores: DataFrame, keys: list[str], metric: str = "mae") -> DataFrame:
    """1/error per model, normalised per series; models with zero error share all the weight."""
    s = W.partitionBy(*keys)  # a few models per series
    perfect = F.col(metric) == 0
    raw = F.when(F.max(perfect).over(s), perfect.cast("double")).otherwise(ratio(F.lit(1.0), metric))
    known = scores.where(F.col(metric).isNotNull()).select(*keys, "model", raw.alias("_raw"))
    return known.select(*keys, "model", ratio("_raw", F.sum("_raw").over(s)).alias("weight"))


def combine(forecasts: DataFrame, scores: DataFrame, keys: list[str], metric: str = "mae") -> DataFrame:
    """Weighted mean of the models' forecasts; weights are renormalised where a model has none.

    A series without any score (a new one) gets the plain mean.
    """
    rows = forecasts.join(weights(scores, keys, metric), [*keys, "model"], "left")
    blend = ratio(F.sum(F.col("weight") * F.col("yhat")), F.sum(F.when(F.col("yhat").isNotNull(), F.col("weight"))))
    return rows.groupBy(*keys, "origin", "period", "h").agg(
        F.lit("combined").alias("model"), F.coalesce(blend, F.avg("yhat")).alias("yhat")
    )


def fallback(frames: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """First non-null yhat in the order of ``frames``, with the name of its ``source``."""
    parts = [df.select(*on, F.col("yhat").alias(f"_{name}")) for name, df in frames.items()]
    wide = reduce(lambda a, b: a.join(b, on, "full_outer"), parts)
    source: Column = F.lit(None).cast("string")
    for name in reversed(list(frames)):
        source = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(source)
    return wide.select(*on, F.coalesce(*[F.col(f"_{n}") for n in frames]).alias("yhat"), source.alias("source"))


def segment_mean(panel: DataFrame, segments: DataFrame, keys: list[str], after, until) -> DataFrame:
    """Mean demand of a segment's series over the periods in (after, until]: the last resort."""
    recent = panel.where((F.col("period") > as_col(after)) & (F.col("period") <= as_col(until)))
    return recent.join(segments.select(*keys, "segment"), keys).groupBy("segment").agg(F.avg("qty").alias("yhat"))


def bottom_up(fc: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Leaf forecasts summed to every level, so that all levels agree."""
    return hierarchy(fc.select("period", *dict.fromkeys(k for lv in levels for k in lv), "yhat"), levels, ("yhat",))


def top_down(fc_total: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """A forecast of the total shared out by each series' part of past demand."""
    per_series = history.groupBy(*keys).agg(F.sum("qty").alias("_q"))
    total = history.agg(F.sum("qty")).scalar()
    shares = per_series.select(*keys, ratio("_q", total).alias("share"))
    # h joins nothing: every series gets every future period, listed in the row
    steps = fc_total.agg(F.sort_array(F.collect_list(F.struct("period", "yhat")))).scalar()
    out = shares.withColumn("_f", F.explode(steps))
    return out.select(*keys, F.col("_f.period").alias("period"), "share", (F.col("share") * F.col("_f.yhat")).alias("yhat"))


def report(scores: DataFrame, models: list[str], base: str, metric: str = "wape") -> DataFrame:
    """One row per segment: the metric of each model and its gain over ``base`` (0.1 = 10 % less error)."""
    wide = scores.groupBy("segment").agg(*[F.max(F.when(F.col("model") == m, F.col(metric))).alias(m) for m in models])
    gains = {f"{m}_gain": 1 - ratio(m, base) for m in models if m != base}
    return wide.withColumns(gains)


@dataclass(frozen=True)
class HybridConfig:
    keys: list[str]
    freq: str
    origin: object  # last known period
    horizon: int
    origins: list  # backtest origins; each plus horizon must not pass ``origin``
    models: dict[str, Forecaster]  # classical models
    routing: dict[str, str]  # segment → model name, 'best' or 'combined'
    metric: str = "mae"
    segment_args: dict = field(default_factory=dict)
    other: str | None = None  # model of segments that the routing does not name
    repair: str = "snaive"  # model that stands in where the routed one has no forecast
    recent: int = 12  # periods behind the segment mean, which stands in where that one has none either
    frames: tuple = ()  # forecast frames of trained models, networks or analogs, from any of the origins
    segments: DataFrame | None = None  # keys and segment; by default the ADI/CV² classes at the origin


def hybrid(panel: DataFrame, cfg: HybridConfig) -> DataFrame:
    """The whole chain on a dense panel: classes, forecasts, backtest, then the routed forecast.

    One row per series of the panel and step, whatever its history: ``source`` tells whether yhat is
    the routed forecast (``routed``), that of ``cfg.repair``, the mean of the segment's recent demand
    (``segment``) or, without any demand to go by, 0 (``none``). ``model`` is the routed choice.

    Forecasts, scores, classes and weights are all kept by series key: one shuffle of the history makes
    an array per series, which is folded once for all origins. Nothing after ``origin`` is looked at but the names of series.
    Per series the routing names a model, 'best' (least backtest error) or 'combined' (weights
    1/error). Frames of other models are scored like the classical ones, by their rows from
    ``cfg.origins``, and can be routed, chosen and blended like them.
    """
    keys, at = cfg.keys, as_col(cfg.origin)
    # the arrays are made where the panel is, without moving its rows; names, classes and means read it back
    stored = durable(panel.select(*keys, "period", "qty"))
    known = stored.where(F.col("period") <= at)
    segments = cfg.segments if cfg.segments is not None else classify_sbc(adi_cv2(known, keys), **cfg.segment_args)
    segments = durable(segments.select(*keys, "segment"))
    # all origins from one array per series; what the last one forecasts has no actuals yet
    every = forecast(panel.where(F.col("period") <= at), keys, cfg.freq, [*cfg.origins, cfg.origin], cfg.horizon, cfg.models, actuals=True)
    for frame in cfg.frames:
        rows = frame.select(*keys, "origin", "model", "h", "period", "yhat")
        earlier = rows.where(F.col("origin") < at).join(known.select(*keys, "period", "qty"), [*keys, "period"])
        last = rows.where(F.col("origin") == at).withColumn("qty", F.lit(None).cast("double"))
        every = every.unionByName(earlier).unionByName(last)
    # a column per step: plain sums and maxima are kept in a hash table, lists would be sorted
    step = lambda h: F.max(F.when((F.col("origin") == at) & (F.col("h") == h), F.col("yhat")))
    past_qty = F.when(F.col("origin") < at, F.col("qty"))
    by_model = every.withColumn("qty", past_qty).groupBy(*keys, "model").agg(
        metric_columns()[cfg.metric].alias("_error"), *[step(h).alias(f"_h{h}") for h in range(1, cfg.horizon + 1)]
    )
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_h{h}").alias("yhat")) for h in range(1, cfg.horizon + 1)])
    by_model = by_model.select(*keys, "model", "_error", ahead.alias("_ahead"))
    # a few models per series: they stay in its row, so nothing has to be joined again
    per_series = by_model.groupBy(*keys).agg(F.collect_list(F.struct("model", "_error", "_ahead")).alias("_models"))
    scored = F.filter("_models", lambda m: m["_error"].isNotNull())
    first = F.array_min(F.transform(scored, lambda m: F.struct(F.round(m["_error"], 9).alias("e"), m["model"].alias("m"))))
    perfect = F.exists(scored, lambda m: m["_error"] == 0)
    raw = F.transform(scored, lambda m: F.struct(
        m["model"].alias("model"), F.when(perfect, (m["_error"] == 0).cast("double")).otherwise(ratio(F.lit(1.0), m["_error"])).alias("w")
    ))
    flat = F.flatten(F.transform("_models", lambda m: F.transform(m["_ahead"], lambda x: F.struct(m["model"].alias("model"), x["h"].alias("h"), x["yhat"].alias("yhat")))))

    target = routed(cfg.routing, cfg.other)
    pick = (
        stored.select(*keys).distinct()
        .join(segments.select(*keys, "segment"), keys, "left")
        .join(per_series.select(*keys, first["m"].alias("_best"), raw.alias("_raw"), flat.alias("_flat")), keys, "left")
        .select(*keys, "segment", "_raw", "_flat", F.when(target == "best", F.col("_best")).otherwise(target).alias("_pick"))
    )
    entries = lambda of: F.map_from_entries(F.transform(F.filter("_flat", of), lambda x: F.struct(x["model"], x["yhat"])))
    steps = pick.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))))
    steps = steps.withColumns({
        "_yhat": entries(lambda x: x["h"] == F.col("h")),
        # weights 1/error, up to a factor that the blend takes out again; no score, no weights
        "_weights": F.when(F.size("_raw") > 0, F.map_from_entries("_raw")),
    })
    means = segment_mean(known, segments, keys, shift_period(at, -cfg.recent, cfg.freq), at).withColumnRenamed("yhat", "_mean")
    steps = steps.join(means, "segment", "left")
    # a single model is a blend with weight 1 on it
    shares = F.when(F.col("_pick") == "combined", F.col("_weights")).when(
        F.col("_pick").isNotNull(), F.create_map(F.col("_pick"), F.lit(1.0))
    )
    used = F.map_filter(shares, lambda m, w: (w > 0) & F.try_element_at("_yhat", m).isNotNull())
    total = lambda value: F.aggregate(F.map_entries(used), F.lit(0.0), lambda t, e: t + value(e))
    chosen = ratio(total(lambda e: e["value"] * F.try_element_at("_yhat", e["key"])), total(lambda e: e["value"]))
    options = {"routed": chosen, cfg.repair: F.try_element_at("_yhat", F.lit(cfg.repair)), "segment": F.col("_mean"), "none": F.lit(0.0)}
    steps = steps.withColumns({f"_o_{name}": c for name, c in options.items()})
    return steps.select(
        *keys, "segment", at.alias("origin"), shift_period(at, F.col("h"), cfg.freq).alias("period"), "h",
        F.col("_pick").alias("model"), F.coalesce(*[F.col(f"_o_{n}") for n in options]).alias("yhat"),
        F.coalesce(*[F.when(F.col(f"_o_{n}").isNotNull(), n) for n in options]).alias("source"),
    )
