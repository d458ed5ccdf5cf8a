"""Pooled rates of items, and features of event properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pooling as P, props as R
from ..sources.tables import table
from .base import PANEL
from .q_forecast import H, ORIGIN
from .q_hybrid import ITEM, by_item, item_panel
from .registry import query

RECENT = 6


def rates_sql(within: str) -> str:
    return by_item(PANEL) + f""",
items AS (SELECT p_partkey AS l_partkey, p_brand FROM part),
s AS (SELECT l_partkey, p_brand, count(qty) AS n, coalesce(sum(qty), 0) AS y, coalesce(sum(qty * qty), 0) AS yy
      FROM items LEFT JOIN (SELECT * FROM panel WHERE period <= DATE '2001-01-01' AND period > DATE '2000-07-01') USING (l_partkey) GROUP BY ALL),
g AS (SELECT p_brand, count(*) AS items, sum(n) AS sn, sum(y) AS sy, sum(n * n) AS nn, sum(y * y / n) AS yr, sum(yy - y * y / n) AS w FROM s WHERE n > 0 GROUP BY ALL),
m AS (SELECT *, sy / sn AS mean, {within} AS within FROM g),
p AS (SELECT *, greatest((yr - sy * mean - (items - 1) * within) / (sn - nn / sn), 0) AS between_ FROM m),
r AS (SELECT l_partkey, s.p_brand, n, y / nullif(n, 0) AS own, mean AS prior,
             CASE WHEN n = 0 OR between_ = 0 THEN 0.0 ELSE n / (n + within / between_) END AS weight
      FROM s JOIN p USING (p_brand))
"""


def items(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")


def recent(spark, sf):
    p = item_panel(spark, sf)
    return p.where((F.col("period") <= F.lit(ORIGIN)) & (F.col("period") > F.add_months(F.lit(ORIGIN), -RECENT)))


@query("pooled_rates", rates_sql("w / (sn - items)") + "SELECT *, weight * coalesce(own, 0) + (1 - weight) * prior AS rate FROM r", rounded="own prior weight rate")
def _(spark, sf):
    return P.pooled_rates(items(spark, sf), recent(spark, sf), ITEM, ["p_brand"], "pooled")


@query("fc_pooled_items", rates_sql("sy / sn") + """
SELECT l_partkey, DATE '2001-01-01' AS origin, 'pooled' AS model, CAST(h AS INTEGER) AS h,
       CAST(DATE '2001-01-01' + to_months(CAST(h AS INTEGER)) AS DATE) AS period, weight * coalesce(own, 0) + (1 - weight) * prior AS yhat
FROM r, range(1, 7) AS t(h)""", rounded="yhat")
def _(spark, sf):
    return P.forecast_pooled(items(spark, sf), item_panel(spark, sf), ITEM, ["p_brand"], "month", ORIGIN, H, RECENT)


@query("event_props", """
SELECT CAST(ts AS DATE) AS period, event_type, count(*) AS n, CAST(count_if(props IS NOT NULL AND coalesce(CASE WHEN json_valid(props) THEN json_type(props) END, '') <> 'OBJECT') AS BIGINT) AS malformed,
       count(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max
FROM events GROUP BY ALL""")
def _(spark, sf):
    e = R.columns_of(table(spark, sf, "events").select("ts", "event_type", "props"), "props")
    return e.groupBy(F.col("ts").cast("date").alias("period"), "event_type").agg(
        F.count("*").alias("n"), F.count_if("props_malformed").alias("malformed"), F.count("props_k").alias("k_n"),
        F.sum("props_k").alias("k_sum"), F.max("props_k").alias("k_max"),
    )
