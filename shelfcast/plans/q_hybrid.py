"""Hybrid framework on classical models, so that every step has an oracle."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import forecast as FC, hybrid as Y, patterns as T, rules as R
from ..operators.score import score
from .base import KEYS, PANEL, materialized, panel
from .q_features import qty_panel
from .q_forecast import FOLDS, H, METRIC_COLS, MODELS, ORIGIN, fc_sql, score_sql
from .q_patterns import SBC_SQL, segments
from .registry import query

ROUTING = {"smooth": "ses", "erratic": "ma", "intermittent": "croston", "lumpy": "sba"}
# backtest folds that end before the origin
PAST = [dt.date(2000, 1, 1), dt.date(2000, 7, 1)]

KNOWN_SBC = """known AS (SELECT * FROM panel WHERE period <= DATE '2001-01-01'),
adi AS (
  SELECT p_brand, c_nationkey, count(*) / nullif(count(*) FILTER (WHERE qty > 0), 0) AS adi,
         count(*) FILTER (WHERE qty > 0) * sum(qty * qty) / nullif(sum(qty) * sum(qty), 0) - 1 AS cv2
  FROM known GROUP BY ALL),
seg AS (
  SELECT p_brand, c_nationkey, CASE WHEN adi IS NULL THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth'
         WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS segment FROM adi)"""
ROUTE_SQL = "routing(segment, model) AS (VALUES " + ", ".join(f"('{s}', '{m}')" for s, m in ROUTING.items()) + ")"
ALL_FC = fc_sql([*PAST, ORIGIN], name="every")
SPLIT = """past AS (SELECT * FROM every WHERE origin < DATE '2001-01-01'),
fc AS (SELECT * FROM every WHERE origin = DATE '2001-01-01')"""
BY_SERIES = score_sql("p_brand, c_nationkey, model", fc="past")
BEST_SQL = """best AS (
  SELECT p_brand, c_nationkey, model, round(mae, 9) AS mae FROM scored
  QUALIFY row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY round(mae, 9), model) = 1)"""
WEIGHT_SQL = """wt AS (
  SELECT p_brand, c_nationkey, model, raw / sum(raw) OVER (PARTITION BY p_brand, c_nationkey) AS weight FROM (
    SELECT *, CASE WHEN min(mae) OVER (PARTITION BY p_brand, c_nationkey) = 0
                   THEN CASE WHEN mae = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / mae END AS raw FROM scored))"""
COMBINED_SQL = """combined AS (
  SELECT p_brand, c_nationkey, origin, period, h, 'combined' AS model,
         coalesce(sum(weight * yhat) / nullif(sum(weight), 0), avg(yhat)) AS yhat
  FROM fc LEFT JOIN wt USING (p_brand, c_nationkey, model) GROUP BY ALL)"""


def known_segments(p):
    return R.classify_sbc(T.adi_cv2(p.where(F.col("period") <= F.lit(ORIGIN)), KEYS)).select(*KEYS, "segment")


def forecasts(p, origins, actuals=False):
    return FC.forecast(p, KEYS, "month", origins, H, MODELS, actuals)


def past_scores(p):
    return score(forecasts(p, PAST, actuals=True), KEYS, [*KEYS, "model"])


@query("route_by_segment", PANEL + f""", {KNOWN_SBC}, {ROUTE_SQL}, {fc_sql([ORIGIN])},
grid AS (SELECT DISTINCT p_brand, c_nationkey, origin, period, h FROM fc)
SELECT p_brand, c_nationkey, origin, period, h, segment, routing.model, yhat
FROM grid LEFT JOIN seg USING (p_brand, c_nationkey) LEFT JOIN routing USING (segment)
LEFT JOIN fc USING (p_brand, c_nationkey, origin, period, h, model)""", rounded="yhat")
def _(spark, sf):
    p = qty_panel(spark, sf)
    return Y.route(known_segments(p), ROUTING, forecasts(p, [ORIGIN]), KEYS)


@query("best_model", PANEL + f", {ALL_FC}, {SPLIT}, {BY_SERIES}, {BEST_SQL} SELECT * FROM best", rounded="mae")
def _(spark, sf):
    return Y.best_model(past_scores(qty_panel(spark, sf)), KEYS)


@query("combine_weighted", PANEL + f""", {ALL_FC}, {SPLIT}, {BY_SERIES}, {WEIGHT_SQL}, {COMBINED_SQL}
SELECT * FROM combined""", rounded="yhat")
def _(spark, sf):
    p = qty_panel(spark, sf)
    return Y.combine(forecasts(p, [ORIGIN]), past_scores(p), KEYS)


@query("fallback_chain", PANEL + f""", {KNOWN_SBC}, {fc_sql([ORIGIN])},
own AS (SELECT fc.* FROM fc JOIN seg USING (p_brand, c_nationkey) WHERE segment = 'smooth' AND model = 'ses'),
seasonal AS (SELECT fc.* FROM fc JOIN seg USING (p_brand, c_nationkey) WHERE segment <> 'lumpy' AND model = 'snaive'),
means AS (
  SELECT segment, avg(qty) AS yhat FROM panel JOIN seg USING (p_brand, c_nationkey)
  WHERE period > DATE '2000-01-01' AND period <= DATE '2001-01-01' GROUP BY segment),
grid AS (SELECT DISTINCT p_brand, c_nationkey, period FROM fc)
SELECT p_brand, c_nationkey, period, coalesce(own.yhat, seasonal.yhat, means.yhat) AS yhat,
       CASE WHEN own.yhat IS NOT NULL THEN 'chosen' WHEN seasonal.yhat IS NOT NULL THEN 'snaive' ELSE 'segment' END AS source
FROM grid JOIN seg USING (p_brand, c_nationkey) JOIN means USING (segment)
LEFT JOIN own USING (p_brand, c_nationkey, period) LEFT JOIN seasonal USING (p_brand, c_nationkey, period)""",
    rounded="yhat")
def _(spark, sf):
    # A chosen model for smooth series only, a seasonal one for all but lumpy series, segment means for all.
    p = qty_panel(spark, sf)
    seg = known_segments(p)
    fc = forecasts(p, [ORIGIN]).join(seg, KEYS)
    means = Y.segment_mean(p, seg, KEYS, dt.date(2000, 1, 1), ORIGIN)
    grid = fc.where(F.col("model") == "naive").select(*KEYS, "period", "segment")
    frames = {
        "chosen": fc.where((F.col("segment") == "smooth") & (F.col("model") == "ses")),
        "snaive": fc.where((F.col("segment") != "lumpy") & (F.col("model") == "snaive")),
        "segment": grid.join(means, "segment"),
    }
    return Y.fallback(frames, [*KEYS, "period"])


@query("reconcile_bottom_up", PANEL + f""", {fc_sql([ORIGIN], ['ses'])}
SELECT CAST(GROUPING(p_brand, c_nationkey) AS BIGINT) AS level_id,
       CASE GROUPING(p_brand, c_nationkey) WHEN 0 THEN 'p_brand_c_nationkey' WHEN 1 THEN 'p_brand'
            WHEN 2 THEN 'c_nationkey' ELSE 'total' END AS level, p_brand, c_nationkey, period, sum(yhat) AS yhat
FROM fc GROUP BY GROUPING SETS ((period), (p_brand, period), (c_nationkey, period), (p_brand, c_nationkey, period))""",
    rounded="yhat")
def _(spark, sf):
    fc = FC.forecast(qty_panel(spark, sf), KEYS, "month", [ORIGIN], H, {"ses": MODELS["ses"]})
    return Y.bottom_up(fc, [[], ["p_brand"], ["c_nationkey"], KEYS])


@query("reconcile_top_down", PANEL + """,
t AS (SELECT period, sum(qty) AS qty FROM panel WHERE period <= DATE '2001-01-01' GROUP BY period),
s AS (SELECT list_reduce(list(qty ORDER BY period), lambda a, x: 0.3 * x + 0.7 * a) AS yhat FROM t),
share AS (SELECT p_brand, c_nationkey, sum(qty) / (SELECT sum(qty) FROM t) AS share FROM panel
          WHERE period <= DATE '2001-01-01' GROUP BY ALL)
SELECT p_brand, c_nationkey, CAST(DATE '2001-01-01' + to_months(CAST(h AS INTEGER)) AS DATE) AS period, share, share * yhat AS yhat
FROM share, s, range(1, 7) AS r(h)""", rounded="share yhat")
def _(spark, sf):
    known = qty_panel(spark, sf).where(F.col("period") <= F.lit(ORIGIN))
    total = known.groupBy(F.lit("all").alias("level"), "period").agg(F.sum("qty").alias("qty"))
    fc = FC.forecast(total, ["level"], "month", [ORIGIN], H, {"ses": MODELS["ses"]})
    return Y.top_down(fc, known, KEYS)


@query("hybrid_report", PANEL + f""", {KNOWN_SBC}, {fc_sql([ORIGIN])},
{score_sql('segment, model', extra='JOIN seg USING (p_brand, c_nationkey)')},
wide AS (SELECT segment, {", ".join(f"max(wape) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS)} FROM scored GROUP BY segment)
SELECT *, {", ".join(f"1 - {m} / nullif(naive, 0) AS {m}_gain" for m in MODELS if m != "naive")} FROM wide""",
    rounded=" ".join([*MODELS, *[f"{m}_gain" for m in MODELS if m != "naive"]]))
def _(spark, sf):
    p = qty_panel(spark, sf)
    fc = forecasts(p, [ORIGIN], actuals=True).join(known_segments(p), KEYS)
    return Y.report(score(fc, KEYS, ["segment", "model"]), list(MODELS), "naive")


CONFIG = Y.HybridConfig(
    keys=KEYS, freq="month", origin=ORIGIN, horizon=H, origins=PAST, models=MODELS,
    routing={"smooth": "ses", "erratic": "combined", "intermittent": "best", "lumpy": "sba"},
)


# every series and step; what the routing gives, else the seasonal naive, else the mean of the segment, else 0
FILL_SQL = """
means AS (SELECT segment, avg(qty) AS mean FROM known JOIN seg USING (p_brand, c_nationkey)
          WHERE period > DATE '2000-01-01' GROUP BY segment),
grid AS (SELECT * FROM (SELECT DISTINCT p_brand, c_nationkey FROM panel), (SELECT CAST(h AS INTEGER) AS h FROM range(1, 7) AS r(h)))
SELECT p_brand, c_nationkey, segment, DATE '2001-01-01' AS origin, CAST(DATE '2001-01-01' + to_months(h) AS DATE) AS period, h,
       pick AS model, coalesce(r.yhat, n.yhat, mean, 0.0) AS yhat,
       CASE WHEN r.yhat IS NOT NULL THEN 'routed' WHEN n.yhat IS NOT NULL THEN 'snaive' WHEN mean IS NOT NULL THEN 'segment' ELSE 'none' END AS source
FROM grid LEFT JOIN seg USING (p_brand, c_nationkey) LEFT JOIN picks USING (p_brand, c_nationkey)
LEFT JOIN (SELECT p_brand, c_nationkey, h, model AS pick, yhat FROM {all}) AS r USING (p_brand, c_nationkey, h, pick)
LEFT JOIN (SELECT p_brand, c_nationkey, h, yhat FROM fc WHERE model = 'snaive') AS n USING (p_brand, c_nationkey, h)
LEFT JOIN means USING (segment)"""
HYBRID_SQL = materialized(PANEL + f""", {KNOWN_SBC}, {ALL_FC}, {SPLIT}, {BY_SERIES}, {BEST_SQL}, {WEIGHT_SQL}, {COMBINED_SQL},
picks AS (SELECT p_brand, c_nationkey, CASE segment WHEN 'smooth' THEN 'ses' WHEN 'lumpy' THEN 'sba' WHEN 'erratic' THEN 'combined'
                 WHEN 'intermittent' THEN best.model END AS pick FROM seg LEFT JOIN best USING (p_brand, c_nationkey)),
either AS (SELECT p_brand, c_nationkey, h, model, yhat FROM fc UNION ALL SELECT p_brand, c_nationkey, h, model, yhat FROM combined),
""" + FILL_SQL.replace("{all}", "either"))


@query("hybrid_run", HYBRID_SQL, rounded="yhat")
def _(spark, sf):
    return Y.hybrid(qty_panel(spark, sf), CONFIG)


# ---- the same at item grain: many short, mostly intermittent series -----------------------------

ITEM = ["l_partkey"]


def by_item(sql: str) -> str:
    return sql.replace("p_brand, c_nationkey", "l_partkey")


def item_panel(spark, sf):
    return panel(spark, sf, ITEM).select(*ITEM, "period", "qty")


@query("hybrid_run_items", by_item(HYBRID_SQL), rounded="yhat")
def _(spark, sf):
    return Y.hybrid(item_panel(spark, sf), replace(CONFIG, keys=ITEM))


@query("rolling_backtest_items", by_item(PANEL + f", {fc_sql(FOLDS)}, {score_sql('model, origin, h')} SELECT * FROM scored"),
       rounded=METRIC_COLS)
def _(spark, sf):
    return FC.backtest(item_panel(spark, sf), ITEM, "month", FOLDS, H, MODELS)


@query("classify_sbc_items", by_item(PANEL + f", {SBC_SQL} SELECT * FROM sbc"))
def _(spark, sf):
    return segments(spark, sf, ITEM)
