"""Minimum-trace reconciliation of forecasts that every level makes for itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import durable
from ..operators import forecast as FC, reconcile as M
from .base import KEYS, PANEL, materialized
from .q_features import qty_panel
from .q_forecast import H, MODELS, ORIGIN, fc_sql
from .q_hybrid import PAST
from .registry import query

NESTED = [[], ["p_brand"], KEYS]
CROSSED = [[], ["p_brand"], ["c_nationkey"], KEYS]

# on a tree the system falls apart: what the levels below say is combined with a node's own forecast on
# the way up, and what is left over is shared out by variance on the way down
TREE_SQL = materialized(PANEL + """,
nodes AS (SELECT coalesce(p_brand, '*') AS p_brand, coalesce(c_nationkey, -1) AS c_nationkey, period, sum(qty) AS qty
          FROM panel GROUP BY GROUPING SETS ((period), (p_brand, period), (p_brand, c_nationkey, period))),
""" + fc_sql([*PAST, ORIGIN], ["ses"], name="every").replace("FROM panel JOIN", "FROM nodes JOIN") + """,
w AS (SELECT p_brand, c_nationkey, greatest(avg(power(qty - yhat, 2)), 1e-6) AS v FROM every JOIN nodes USING (p_brand, c_nationkey, period)
      WHERE origin < DATE '2001-01-01' GROUP BY ALL),
b AS (SELECT p_brand, c_nationkey, period, yhat AS f, v FROM every JOIN w USING (p_brand, c_nationkey) WHERE origin = DATE '2001-01-01'),
leaf AS (SELECT * FROM b WHERE c_nationkey >= 0),
up1 AS (SELECT p_brand, period, sum(f) AS s, sum(v) AS sv FROM leaf GROUP BY ALL),
brand AS (SELECT p_brand, period, s, sv, (b.f * sv + s * b.v) / (b.v + sv) AS f, b.v * sv / (b.v + sv) AS v
          FROM up1 JOIN b USING (p_brand, period) WHERE c_nationkey = -1 AND p_brand <> '*'),
up2 AS (SELECT period, sum(f) AS s, sum(v) AS sv FROM brand GROUP BY ALL),
total AS (SELECT period, s, sv, (b.f * sv + s * b.v) / (b.v + sv) AS f FROM up2 JOIN b USING (period) WHERE p_brand = '*'),
brand2 AS (SELECT p_brand, period, brand.s, brand.sv, brand.f + brand.v / total.sv * (total.f - total.s) AS f FROM brand JOIN total USING (period)),
leaf2 AS (SELECT p_brand, leaf.c_nationkey, period, leaf.f + leaf.v / brand2.sv * (brand2.f - brand2.s) AS yhat
          FROM leaf JOIN brand2 USING (p_brand, period))
""") + """
SELECT CASE WHEN c_nationkey IS NOT NULL THEN 'p_brand_c_nationkey' WHEN p_brand IS NOT NULL THEN 'p_brand' ELSE 'total' END AS level,
       p_brand, c_nationkey, period, sum(yhat) AS yhat
FROM leaf2 GROUP BY GROUPING SETS ((period), (p_brand, period), (p_brand, c_nationkey, period))"""


def reconciled(spark, sf, levels):
    p = durable(qty_panel(spark, sf))
    known = p.where(F.col("period") <= F.lit(ORIGIN))
    every = FC.forecast(M.node_panel(known, levels), ["node"], "month", [*PAST, ORIGIN], H, {"ses": MODELS["ses"]}, actuals=True)
    every = durable(every)
    base = every.where(F.col("origin") == F.lit(ORIGIN)).select("node", "period", "yhat")
    var = M.variances(every.where(F.col("origin") < F.lit(ORIGIN)))
    return M.min_trace(base, var, p, levels).select("level", *KEYS, "period", "yhat")


@query("reconcile_min_trace", TREE_SQL, rounded="yhat")
def _(spark, sf):
    return reconciled(spark, sf, NESTED)


@query("reconcile_min_trace_crossed", rounded="yhat")
def _(spark, sf):
    """Brands and nations cross, so the system has no closed form; tests hold it against plain algebra."""
    return reconciled(spark, sf, CROSSED)
