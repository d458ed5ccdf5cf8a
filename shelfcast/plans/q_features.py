"""Feature engineering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import features as X
from ..sources.tables import table
from .base import KEYS, PANEL, WEEKLY, by_brand_week, panel
from .registry import query

W_SQL = "WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period)"


def qty_panel(spark, sf):
    return panel(spark, sf).select(*KEYS, "period", "qty")


@query("feat_calendar", PANEL + """,
p AS (SELECT *, CAST(period + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last_d FROM panel)
SELECT p_brand, c_nationkey, period, CAST(year(period) AS INTEGER) AS year, CAST(quarter(period) AS INTEGER) AS quarter,
       CAST(month(period) AS INTEGER) AS month, CAST(weekofyear(period) AS INTEGER) AS iso_week,
       CAST(isodow(period) AS INTEGER) AS iso_weekday, day(period) = 1 AS is_month_start,
       last_d = last_day(last_d) AS is_month_end FROM p""")
def _(spark, sf):
    return X.calendar(panel(spark, sf).select(*KEYS, "period"), "month")


@query("feat_lags", PANEL + f"""
SELECT p_brand, c_nationkey, period, qty, lag(qty, 1) OVER w AS lag_1, lag(qty, 2) OVER w AS lag_2,
       lag(qty, 12) OVER w AS lag_12 FROM panel {W_SQL}""")
def _(spark, sf):
    return X.lags(qty_panel(spark, sf), KEYS, [1, 2, 12])


def _rolling_sql(n: int) -> str:
    over = f"OVER (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return (
        f"avg(qty) {over} AS mean_{n}, stddev_samp(qty) {over} AS sd_{n}, min(qty) {over} AS min_{n}, "
        f"max(qty) {over} AS max_{n}, avg(CASE WHEN qty = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) {over} AS zero_share_{n}"
    )


@query("feat_rolling", PANEL + f"""
SELECT p_brand, c_nationkey, period, qty, {_rolling_sql(3)}, {_rolling_sql(12)} FROM panel""",
    rounded="mean_3 sd_3 zero_share_3 mean_12 sd_12 zero_share_12")
def _(spark, sf):
    return X.rolling(qty_panel(spark, sf), KEYS, [3, 12])


@query("feat_expanding", PANEL + """
SELECT p_brand, c_nationkey, period, qty, avg(qty) OVER w AS mean_all, count(qty) OVER w AS n_all FROM panel
WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    rounded="mean_all")
def _(spark, sf):
    return X.expanding(qty_panel(spark, sf), KEYS)


@query("feat_ewma", PANEL + f""",
past AS (SELECT *, [lag(qty, 1) OVER w, lag(qty, 2) OVER w, lag(qty, 3) OVER w, lag(qty, 4) OVER w,
                    lag(qty, 5) OVER w, lag(qty, 6) OVER w] AS h FROM panel {W_SQL}),
item AS (SELECT p_brand, c_nationkey, period, qty, unnest(h) AS y, generate_subscripts(h, 1) AS i FROM past)
SELECT p_brand, c_nationkey, period, any_value(qty) AS qty,
       sum(y * 0.3 * power(0.7::DOUBLE, i - 1)) / sum(0.3 * power(0.7::DOUBLE, i - 1)) FILTER (WHERE y IS NOT NULL) AS ewma
FROM item GROUP BY ALL""", rounded="ewma")
def _(spark, sf):
    return X.ewma(qty_panel(spark, sf), KEYS, 0.3, 6)


@query("feat_diff", PANEL + f"""
SELECT p_brand, c_nationkey, period, qty, lag(qty, 1) OVER w - lag(qty, 2) OVER w AS diff_1,
       (lag(qty, 1) OVER w - lag(qty, 2) OVER w) / nullif(lag(qty, 2) OVER w, 0) AS pct_1,
       lag(qty, 1) OVER w - lag(qty, 13) OVER w AS diff_season FROM panel {W_SQL}""")
def _(spark, sf):
    return X.diffs(qty_panel(spark, sf), KEYS, 12)


@query("feat_fourier", PANEL + """,
t AS (SELECT p_brand, c_nationkey, period, 2 * pi() * (year(period) * 12 + month(period) - 1) / 12 AS a FROM panel)
SELECT p_brand, c_nationkey, period, sin(a) AS sin_1, cos(a) AS cos_1, sin(2 * a) AS sin_2, cos(2 * a) AS cos_2 FROM t""",
    rounded="sin_1 cos_1 sin_2 cos_2")
def _(spark, sf):
    return X.fourier(panel(spark, sf).select(*KEYS, "period"), "month", 12, 2)


@query("feat_promo", PANEL + """,
t AS (SELECT *, year(period) * 12 + month(period) AS i FROM panel)
SELECT p_brand, c_nationkey, period, promo, lag(promo, 1) OVER w AS promo_lag_1, lag(promo, 2) OVER w AS promo_lag_2,
       CAST(i - max(CASE WHEN promo >= 0.5 THEN i END) OVER (
         PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         AS INTEGER) AS since_promo FROM t """ + W_SQL)
def _(spark, sf):
    return X.promo(panel(spark, sf).select(*KEYS, "period", "promo"), KEYS, "month")


PAYDAYS_SQL = "paydays AS (SELECT CAST(min(o_orderdate) AS DATE) AS ds FROM orders GROUP BY date_trunc('month', o_orderdate))"


def paydays(spark, sf):
    """A calendar known ahead: the first order day of each month."""
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("ds"))
    return o.groupBy(F.trunc("ds", "month")).agg(F.min("ds").alias("ds")).select("ds")


@query("feat_event_distance", WEEKLY + f""", {PAYDAYS_SQL}
SELECT p_brand, period, qty,
       CAST(date_diff('day', (SELECT max(ds) FROM paydays WHERE ds <= period), period) AS INTEGER) AS since_event,
       CAST(date_diff('day', period, (SELECT min(ds) FROM paydays WHERE ds >= period)) AS INTEGER) AS to_event
FROM panel""")
def _(spark, sf):
    return X.event_distance(by_brand_week(spark, sf).select("p_brand", "period", "qty"), paydays(spark, sf))


URGENT_SQL = """urgent AS (
  SELECT c_nationkey, CAST(o_orderdate AS DATE) AS ds, count(*) AS urgent_orders, max(o_totalprice) AS top_price
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)"""


def urgent(spark, sf):
    """An external series by nation and irregular day: urgent orders and their largest price."""
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy("c_nationkey", F.col("o_orderdate").cast("date").alias("ds"))
        .agg(F.count("*").alias("urgent_orders"), F.max("o_totalprice").alias("top_price"))
    )


def _asof_sql(op: str) -> str:
    return PANEL + f""", {URGENT_SQL}
SELECT p.p_brand, p.c_nationkey, p.period, p.qty, u.urgent_orders, u.top_price
FROM panel p ASOF LEFT JOIN urgent u ON p.c_nationkey = u.c_nationkey AND p.period {op} u.ds"""


@query("feat_asof", _asof_sql(">"))
def _(spark, sf):
    return X.asof(qty_panel(spark, sf), urgent(spark, sf), ["c_nationkey"], ["urgent_orders", "top_price"])


@query("feat_asof_known", _asof_sql(">="))
def _(spark, sf):
    return X.asof(
        qty_panel(spark, sf), urgent(spark, sf), ["c_nationkey"], ["urgent_orders", "top_price"], known_by_t=True
    )


@query("feat_recency", PANEL + """,
t AS (SELECT *, year(period) * 12 + month(period) AS i FROM panel)
SELECT p_brand, c_nationkey, period, qty,
       CAST(i - last_value(CASE WHEN qty > 0 THEN i END IGNORE NULLS) OVER w AS INTEGER) AS since_sale,
       last_value(CASE WHEN qty > 0 THEN qty END IGNORE NULLS) OVER w AS last_size FROM t
WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return X.recency(qty_panel(spark, sf), KEYS, "month")


@query("feat_target_enc", PANEL + """,
c AS (SELECT p_brand, period, sum(qty) AS y, count(*) AS n FROM panel GROUP BY ALL),
e AS (SELECT a.p_brand, a.period, sum(b.y) FILTER (WHERE b.p_brand = a.p_brand) AS y,
             sum(b.n) FILTER (WHERE b.p_brand = a.p_brand) AS n, sum(b.y) / sum(b.n) AS g
      FROM c a LEFT JOIN c b ON b.period < a.period GROUP BY ALL)
SELECT p.p_brand, p.c_nationkey, p.period, p.qty,
       CASE WHEN g IS NOT NULL THEN (coalesce(e.y, 0) + 20 * g) / (coalesce(e.n, 0) + 20) END AS p_brand_enc
FROM panel p JOIN e ON e.p_brand = p.p_brand AND e.period = p.period""", rounded="p_brand_enc")
def _(spark, sf):
    return X.target_encode(qty_panel(spark, sf), "p_brand", 20.0)


@query("feat_onehot", """
WITH seen AS (
  SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority),
stat AS (
  SELECT o_orderstatus AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS i
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus),
size AS (SELECT (SELECT count(*) FROM seen) AS np, (SELECT count(*) FROM stat) AS ns)
SELECT o_orderkey, coalesce(seen.i, np)::DOUBLE AS o_orderpriority_idx, coalesce(stat.i, ns)::DOUBLE AS o_orderstatus_idx,
       CAST(np + 1 AS INTEGER) AS priority_slots, CAST(coalesce(stat.i, ns) AS INTEGER) AS status_hot
FROM orders CROSS JOIN size LEFT JOIN seen ON seen.v = o_orderpriority LEFT JOIN stat ON stat.v = o_orderstatus""")
def _(spark, sf):
    # Fitted without the finished orders, so that their status is a value never seen.
    from pyspark.ml.functions import vector_to_array

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    model = X.encode(o.where(F.col("o_orderstatus") != "F"), ["o_orderpriority", "o_orderstatus"])
    hot = vector_to_array("o_orderstatus_vec")
    return model.transform(o).select(
        "o_orderkey", "o_orderpriority_idx", "o_orderstatus_idx",
        (F.size(vector_to_array("o_orderpriority_vec"))).alias("priority_slots"),
        (F.array_position(hot, F.lit(1.0)) - 1).cast("int").alias("status_hot"),
    )


@query("feat_scale", PANEL + """,
s AS (SELECT p_brand, c_nationkey, avg(qty) AS scale_mean, stddev_pop(qty) AS scale_sd FROM panel
      WHERE period < DATE '2000-01-01' GROUP BY ALL)
SELECT p.p_brand, p.c_nationkey, period, qty, scale_mean, scale_sd,
       CASE WHEN scale_sd > 0 THEN (qty - scale_mean) / scale_sd WHEN scale_sd = 0 THEN 0.0 END AS scaled,
       ln(1 + qty) AS scaled_log FROM panel p LEFT JOIN s USING (p_brand, c_nationkey)""",
    rounded="scale_mean scale_sd scaled scaled_log")
def _(spark, sf):
    z = X.scale(qty_panel(spark, sf), KEYS, "standard", dt.date(2000, 1, 1))
    return z.withColumn("scaled_log", F.log1p("qty"))


def supervised_sql(h: int) -> str:
    sold = "CASE WHEN qty > 0 THEN year(period) * 12 + month(period) END"
    return f"""supervised AS (
  SELECT p_brand, c_nationkey, lag(period) OVER w AS origin, lead(period, {h - 1}) OVER w AS period, {h} AS h,
         lag(qty, 1) OVER w AS lag_1, lag(qty, 2) OVER w AS lag_2, lag(qty, 3) OVER w AS lag_3,
         lag(qty, 12) OVER w AS lag_12, {_rolling_sql(3)}, {_rolling_sql(12)},
         CAST(year(period) * 12 + month(period) - last_value({sold} IGNORE NULLS) OVER (
           PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS INTEGER) AS since_sale,
         CAST(month(lead(period, {h - 1}) OVER w) AS INTEGER) AS month, lead(qty, {h - 1}) OVER w AS label
  FROM panel {W_SQL})"""


SUPERVISED_SQL = PANEL + ", " + supervised_sql(3)


@query("supervised_matrix", SUPERVISED_SQL + """
SELECT * FROM supervised WHERE origin IS NOT NULL AND period IS NOT NULL""",
    rounded="mean_3 sd_3 zero_share_3 mean_12 sd_12 zero_share_12")
def _(spark, sf):
    return X.supervised(qty_panel(spark, sf), KEYS, "month", h=3)


RANKED = ["lag_1", "lag_2", "lag_3", "lag_12", "mean_3", "sd_3", "mean_12", "zero_share_12", "since_sale", "month", "h"]


@query("feat_ranking", SUPERVISED_SQL + ",\nlong AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) FILTER (WHERE {c} IS NOT NULL) > 0 "
    f"THEN corr({c}, label) FILTER (WHERE {c} IS NOT NULL) END AS corr FROM supervised "
    "WHERE origin IS NOT NULL AND period IS NOT NULL" for c in RANKED) + """)
SELECT feature, corr, CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM long""",
    rounded="corr")
def _(spark, sf):
    return X.rank_features(X.supervised(qty_panel(spark, sf), KEYS, "month", h=3), RANKED, "label")
