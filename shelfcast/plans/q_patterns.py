"""Demand pattern analysis and rule-based classification."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import period_index
from ..operators import patterns as T, rules as R
from ..sources.tables import table
from .base import KEYS, PANEL, SALES_SQL, SPARSE, WHOLE, order_span, panel, sparse_panel, sparse_sql, whole_panel, whole_sql
from .q_features import qty_panel
from .registry import query

SERIES = "p_brand, c_nationkey"

ADI_SQL = """adi AS (
  SELECT p_brand, c_nationkey, count(*) AS n, count(*) FILTER (WHERE qty > 0) AS nonzero,
         avg(qty) FILTER (WHERE qty > 0) AS mean_size, count(*) / nullif(count(*) FILTER (WHERE qty > 0), 0) AS adi,
         count(*) FILTER (WHERE qty > 0) * sum(qty * qty) / nullif(sum(qty) * sum(qty), 0) - 1 AS cv2
  FROM panel GROUP BY ALL)"""
SBC_SQL = ADI_SQL + """,
sbc AS (
  SELECT *, CASE WHEN adi IS NULL THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth'
                 WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS segment
  FROM adi)"""


def interval_profile(spark, sf, keys=KEYS):
    """ADI and CV² from the sparse panel: the number of periods is known, so no zero row is made."""
    lo, hi = order_span(spark, sf, "month")
    n = period_index(hi, "month") - period_index(lo, "month")
    return T.adi_cv2(sparse_panel(spark, sf, keys, span=(lo, hi)), keys, n_periods=n)


def segments(spark, sf, keys=KEYS):
    return R.classify_sbc(interval_profile(spark, sf, keys))


@query("series_profile", PANEL + """
SELECT p_brand, c_nationkey, count(*) AS n, avg(CASE WHEN qty = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_share,
       avg(qty) AS mean, stddev_samp(qty) AS sd, min(qty) AS min, quantile_cont(qty, 0.25) AS q1,
       quantile_cont(qty, 0.5) AS median, quantile_cont(qty, 0.75) AS q3, max(qty) AS max,
       min(period) AS first_period, max(period) AS last_period FROM panel GROUP BY ALL""",
    rounded="zero_share mean sd q1 median q3")
def _(spark, sf):
    return T.profile(panel(spark, sf), KEYS)


@query("adi_cv2", PANEL + f", {ADI_SQL} SELECT * FROM adi")
def _(spark, sf):
    return interval_profile(spark, sf)


@query("classify_sbc", PANEL + f", {SBC_SQL} SELECT * FROM sbc")
def _(spark, sf):
    return segments(spark, sf)


@query("interval_hist", SPARSE + """,
g AS (SELECT p_brand, c_nationkey, date_diff('month', lag(period) OVER (PARTITION BY p_brand, c_nationkey ORDER BY period), period) AS gap
      FROM sparse WHERE qty > 0)
SELECT p_brand, c_nationkey, CAST(gap AS INTEGER) AS gap, count(*) AS times FROM g WHERE gap IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return T.intervals(sparse_panel(spark, sf), KEYS, "month")


@query("acf", PANEL + """,
m AS (SELECT *, qty - avg(qty) OVER (PARTITION BY p_brand, c_nationkey) AS d,
             row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY period) AS i FROM panel),
v AS (SELECT p_brand, c_nationkey, sum(d * d) AS ss FROM m GROUP BY ALL)
SELECT a.p_brand, a.c_nationkey, CAST(a.i - b.i AS INTEGER) AS lag, sum(a.d * b.d) / any_value(ss) AS acf
FROM m a JOIN m b ON a.p_brand = b.p_brand AND a.c_nationkey = b.c_nationkey AND a.i - b.i BETWEEN 1 AND 13
JOIN v ON v.p_brand = a.p_brand AND v.c_nationkey = a.c_nationkey GROUP BY ALL""", rounded="acf")
def _(spark, sf):
    return T.acf(qty_panel(spark, sf), KEYS, 13)


@query("trend_fit", PANEL + """,
t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, c_nationkey ORDER BY period) - 1 AS i FROM panel)
SELECT p_brand, c_nationkey, regr_slope(qty, i) AS slope, regr_intercept(qty, i) AS intercept, regr_r2(qty, i) AS r2
FROM t GROUP BY ALL""", rounded="slope intercept r2")
def _(spark, sf):
    return T.trend(panel(spark, sf), KEYS, "month")


DECOMPOSED_SQL = """tr AS (
  SELECT p_brand, c_nationkey, period, qty, CAST(month(period) - 1 AS INTEGER) AS position,
         CASE WHEN count(qty) OVER wide = 13 THEN (sum(qty) OVER wide - 0.5 * (lag(qty, 6) OVER w + lead(qty, 6) OVER w)) / 12 END AS trend
  FROM panel WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period),
    wide AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
raw AS (SELECT p_brand, c_nationkey, position, avg(qty - trend) AS idx FROM tr GROUP BY ALL),
cen AS (SELECT *, idx - avg(idx) OVER (PARTITION BY p_brand, c_nationkey) AS seasonal FROM raw),
decomposed AS (
  SELECT tr.*, seasonal, qty - trend - seasonal AS remainder
  FROM tr JOIN cen USING (p_brand, c_nationkey, position))"""


@query("decompose", PANEL + f", {DECOMPOSED_SQL} SELECT * FROM decomposed", rounded="trend seasonal remainder")
def _(spark, sf):
    return T.decompose(qty_panel(spark, sf), KEYS, "month", 12)


@query("strengths", PANEL + f""", {DECOMPOSED_SQL}
SELECT p_brand, c_nationkey,
       greatest(0.0, 1 - var_pop(remainder) / nullif(var_pop(remainder + trend), 0)) AS trend_strength,
       greatest(0.0, 1 - var_pop(remainder) / nullif(var_pop(remainder + seasonal), 0)) AS seasonal_strength
FROM decomposed WHERE remainder IS NOT NULL GROUP BY ALL""", rounded="trend_strength seasonal_strength")
def _(spark, sf):
    return T.strengths(T.decompose(qty_panel(spark, sf), KEYS, "month", 12), KEYS)


@query("seasonal_profile", SPARSE + "\nSELECT p_brand, c_nationkey, " + ", ".join(
    f"coalesce(sum(qty) FILTER (WHERE month(period) = {i}), 0) / sum(qty) AS month_{i}" for i in range(1, 13)
) + " FROM sparse GROUP BY ALL")
def _(spark, sf):
    return T.seasonal_share(sparse_panel(spark, sf), KEYS, "month")


@query("weekday_profile", "WITH " + sparse_sql("p_brand", "day") + "\nSELECT p_brand, " + ", ".join(
    f"coalesce(sum(qty) FILTER (WHERE isodow(period) = {i}), 0) / sum(qty) AS weekday_{i}" for i in range(1, 8)
) + " FROM sparse GROUP BY ALL")
def _(spark, sf):
    return T.seasonal_share(sparse_panel(spark, sf, ["p_brand"], "day"), ["p_brand"], "weekday")


@query("promo_uplift", PANEL + """
SELECT p_brand, c_nationkey, count(*) FILTER (WHERE promo >= 0.5) AS promo_periods,
       avg(qty) FILTER (WHERE promo >= 0.5) AS promo_mean, avg(qty) FILTER (WHERE promo < 0.5) AS base_mean,
       avg(qty) FILTER (WHERE promo >= 0.5) / nullif(avg(qty) FILTER (WHERE promo < 0.5), 0) AS uplift
FROM panel GROUP BY ALL""", rounded="promo_mean base_mean uplift")
def _(spark, sf):
    return T.promo_uplift(panel(spark, sf), KEYS)


@query("pattern_crosstab", PANEL + f", {SBC_SQL}\nSELECT r_name, " + ", ".join(
    f"count(*) FILTER (WHERE segment = '{s}') AS {s}" for s in R.SBC
) + " FROM sbc JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def _(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), "r_name"
    )
    return T.crosstab(segments(spark, sf).join(place, "c_nationkey"), "r_name", "segment", R.SBC)


ITEMS_SQL = "WITH " + whole_sql("l_partkey", "month") + """,
items AS (SELECT l_partkey, sum(CAST(round(revenue * 100) AS BIGINT)) AS cents FROM whole GROUP BY l_partkey),
ranked AS (
  SELECT *, (sum(cents) OVER (ORDER BY cents DESC, l_partkey ROWS UNBOUNDED PRECEDING) - cents) / sum(cents) OVER () AS share_before
  FROM items),
abc AS (SELECT l_partkey, CAST(cents AS BIGINT) AS cents, share_before,
               CASE WHEN share_before < 0.8 THEN 'A' WHEN share_before < 0.95 THEN 'B' ELSE 'C' END AS abc FROM ranked)
"""


def item_cents(spark, sf, keys):
    p = whole_panel(spark, sf, keys)
    return p.groupBy(*keys).agg(F.sum(F.round(F.col("revenue") * 100).cast("long")).alias("cents"))


@query("classify_abc", ITEMS_SQL + " SELECT * FROM abc", rounded="share_before")
def _(spark, sf):
    return R.classify_abc(item_cents(spark, sf, ["l_partkey"]), ["l_partkey"], "cents")


@query("classify_abc_by", WHOLE + """,
items AS (SELECT p_brand, c_nationkey, sum(CAST(round(revenue * 100) AS BIGINT)) AS cents FROM whole GROUP BY ALL),
ranked AS (
  SELECT *, (sum(cents) OVER (PARTITION BY c_nationkey ORDER BY cents DESC, p_brand ROWS UNBOUNDED PRECEDING) - cents)
            / sum(cents) OVER (PARTITION BY c_nationkey) AS share_before FROM items)
SELECT p_brand, c_nationkey, CAST(cents AS BIGINT) AS cents, share_before,
       CASE WHEN share_before < 0.8 THEN 'A' WHEN share_before < 0.95 THEN 'B' ELSE 'C' END AS abc FROM ranked""",
    rounded="share_before")
def _(spark, sf):
    return R.classify_abc(item_cents(spark, sf, KEYS), KEYS, "cents", by=["c_nationkey"])


VARIATION_SQL = """cv AS (
  SELECT p_brand, c_nationkey, sum(qty) AS qty, stddev_pop(qty) / nullif(avg(qty), 0) AS cv FROM panel GROUP BY ALL),
xyz AS (SELECT *, CASE WHEN cv < 0.5 THEN 'X' WHEN cv < 1.0 THEN 'Y' ELSE 'Z' END AS xyz FROM cv)"""


@query("classify_xyz", PANEL + f", {VARIATION_SQL} SELECT * FROM xyz", rounded="cv")
def _(spark, sf):
    return R.classify_xyz(T.variation(panel(spark, sf), KEYS))


@query("abc_xyz_matrix", PANEL + f""", {VARIATION_SQL}, {whole_sql().removeprefix(SALES_SQL + ",")},
items AS (SELECT p_brand, c_nationkey, sum(CAST(round(revenue * 100) AS BIGINT)) AS cents FROM whole GROUP BY ALL),
ranked AS (SELECT *, (sum(cents) OVER (ORDER BY cents DESC, p_brand, c_nationkey ROWS UNBOUNDED PRECEDING) - cents)
                     / sum(cents) OVER () AS s FROM items)
SELECT CASE WHEN s < 0.8 THEN 'A' WHEN s < 0.95 THEN 'B' ELSE 'C' END AS abc, xyz, count(*) AS series,
       CAST(sum(cents) AS BIGINT) AS cents FROM ranked JOIN xyz USING (p_brand, c_nationkey) GROUP BY ALL""")
def _(spark, sf):
    abc = R.classify_abc(item_cents(spark, sf, KEYS), KEYS, "cents")
    return R.abc_xyz(abc, R.classify_xyz(T.variation(panel(spark, sf), KEYS)), KEYS, "cents")


@query("lifecycle_stage", "WITH " + sparse_sql("l_partkey", "month") + """,
u AS (SELECT l_partkey, date_diff('month', min(period) FILTER (WHERE period <= DATE '1996-06-01'), DATE '1996-06-01') AS age,
             date_diff('month', max(period) FILTER (WHERE period <= DATE '1996-06-01'), DATE '1996-06-01') AS idle
      FROM sparse WHERE qty > 0 GROUP BY ALL)
SELECT l_partkey, CAST(age AS INTEGER) AS age, CAST(idle AS INTEGER) AS idle,
       CASE WHEN age IS NULL THEN 'unborn' WHEN idle >= 9 THEN 'ended' WHEN idle >= 4 THEN 'dormant'
            WHEN age < 12 THEN 'new' ELSE 'active' END AS stage FROM u""")
def _(spark, sf):
    return R.lifecycle(
        sparse_panel(spark, sf, ["l_partkey"]), ["l_partkey"], "month", dt.date(1996, 6, 1), new_n=12, dormant_n=4, ended_n=9
    )


RULES = [  # priority, label, adi lo/hi, cv2 lo/hi, cv lo/hi
    (1, "steady", None, 1.1, None, 0.49, None, 0.75),
    (2, "busy", None, 1.32, None, None, None, None),
    (3, "spiky", None, None, 0.6, None, 1.2, None),
    (4, "rare", 2.0, None, None, None, None, None),
    (5, "sporadic", 1.32, 2.0, None, 0.49, None, None),
]
RULE_DDL = "priority int, label string, adi_lo double, adi_hi double, cv2_lo double, cv2_hi double, cv_lo double, cv_hi double"
_rule_values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RULES)


@query("rule_table_classify", PANEL + f""", {ADI_SQL}, {VARIATION_SQL},
rules(priority, label, adi_lo, adi_hi, cv2_lo, cv2_hi, cv_lo, cv_hi) AS (VALUES {_rule_values}),
hit AS (
  SELECT a.p_brand, a.c_nationkey, label, row_number() OVER (PARTITION BY a.p_brand, a.c_nationkey ORDER BY priority) AS rn
  FROM adi a JOIN cv USING (p_brand, c_nationkey)
  JOIN rules r ON coalesce(adi >= adi_lo, true) AND coalesce(adi < adi_hi, true) AND coalesce(cv2 >= cv2_lo, true)
    AND coalesce(cv2 < cv2_hi, true) AND coalesce(cv >= cv_lo, true) AND coalesce(cv < cv_hi, true))
SELECT p_brand, c_nationkey, adi, cv2, cv, coalesce(label, 'unmatched') AS label
FROM adi JOIN cv USING (p_brand, c_nationkey) LEFT JOIN (SELECT * FROM hit WHERE rn = 1) USING (p_brand, c_nationkey)""",
    rounded="cv")
def _(spark, sf):
    prof = T.wide_profile(panel(spark, sf), KEYS).select(*KEYS, "adi", "cv2", "cv")
    return R.classify_rules(prof, spark.createDataFrame(RULES, RULE_DDL), ["adi", "cv2", "cv"])


@query("class_transition", PANEL + """,
h AS (SELECT p_brand, c_nationkey, period < DATE '1998-07-01' AS early, count(*) / nullif(count(*) FILTER (WHERE qty > 0), 0) AS adi,
             count(*) FILTER (WHERE qty > 0) * sum(qty * qty) / nullif(sum(qty) * sum(qty), 0) - 1 AS cv2 FROM panel GROUP BY ALL),
s AS (SELECT *, CASE WHEN adi IS NULL THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth'
                     WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS segment FROM h)
SELECT a.segment AS from_segment, b.segment AS to_segment, count(*) AS series
FROM s a JOIN s b USING (p_brand, c_nationkey) WHERE a.early AND NOT b.early GROUP BY ALL""")
def _(spark, sf):
    return R.transitions(qty_panel(spark, sf), KEYS, dt.date(1998, 7, 1))
