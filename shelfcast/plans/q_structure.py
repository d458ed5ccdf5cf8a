"""Level shifts, seasons and robust decomposition of the demand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import durable
from ..operators import elastic as E, shifts as G, spectrum as P
from .base import KEYS, PANEL, WEEKLY, by_brand_week
from .q_features import qty_panel
from .q_hybrid import ITEM, by_item, item_panel
from .registry import query

# the same program without dropping any change: every end looks at every beginning
SHIFTS_SQL = PANEL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
pre AS (SELECT p_brand, c_nationkey, period, sum(qty) OVER w AS c1, sum(qty * qty) OVER w AS c2, qty - lag(qty) OVER w AS d
        FROM panel WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY period)),
a AS (SELECT p_brand, c_nationkey, min(period) AS first, count(*) AS n, list_prepend(0.0::DOUBLE, list(c1 ORDER BY period)) AS s1,
             list_prepend(0.0::DOUBLE, list(c2 ORDER BY period)) AS s2, 2.0 * (sum(d * d) / (2 * (count(*) - 1))) * ln(count(*)) AS beta
      FROM pre GROUP BY ALL),
dp AS (
  SELECT p_brand, c_nationkey, n, s1, s2, beta, 0 AS t, [0.0::DOUBLE] AS f, [0::BIGINT] AS g FROM a
  UNION ALL
  SELECT p_brand, c_nationkey, n, s1, s2, beta, t + 1, list_append(f, best.v), list_append(g, best.s) FROM (
    SELECT *, CASE WHEN t + 1 < 3 THEN {'v': 'infinity'::DOUBLE, 's': 0::BIGINT} ELSE list_min(list_transform(range(0, t - 1), lambda s:
      {'v': f[s + 1] + ((s2[t + 2] - s2[s + 1]) - (s1[t + 2] - s1[s + 1]) * (s1[t + 2] - s1[s + 1]) / (t + 1 - s)) + beta, 's': s})) END AS best
    FROM dp WHERE t < n)),
back AS (
  SELECT p_brand, c_nationkey, g, CAST(t AS BIGINT) AS b, g[t + 1] AS a FROM dp WHERE t = n
  UNION ALL SELECT p_brand, c_nationkey, g, a AS b, g[a + 1] AS a FROM back WHERE a > 0),
seg AS (
  SELECT p_brand, c_nationkey, CAST(row_number() OVER w AS INTEGER) AS segment, back.a, b, first, (s1[b + 1] - s1[back.a + 1]) / (b - back.a) AS level
  FROM back JOIN a USING (p_brand, c_nationkey) WINDOW w AS (PARTITION BY p_brand, c_nationkey ORDER BY b))
SELECT p_brand, c_nationkey, segment, CAST(first + to_months(CAST(a AS INTEGER)) AS DATE) AS start,
       CAST(first + to_months(CAST(b - 1 AS INTEGER)) AS DATE) AS "end", b - a AS n, level,
       level - lag(level) OVER (PARTITION BY p_brand, c_nationkey ORDER BY segment) AS shift
FROM seg"""


@query("level_shifts", SHIFTS_SQL, rounded="level shift")
def _(spark, sf):
    return G.level_shifts(qty_panel(spark, sf), KEYS, "month")


@query("level_shifts_items", by_item(SHIFTS_SQL), rounded="level shift")
def _(spark, sf):
    return G.level_shifts(item_panel(spark, sf), ITEM, "month")


# cosine and sine sums of every frequency, added up one by one
POWER_SQL = """,
t AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n,
             qty - avg(qty) OVER (PARTITION BY p_brand) AS q FROM panel),
k AS (SELECT p_brand, n, k, sum(q * cos(2 * pi() * (k * i % n) / n)) AS c, sum(q * sin(2 * pi() * (k * i % n) / n)) AS s
      FROM t, range(1, 1000) AS r(k) WHERE 2 * k <= n GROUP BY ALL),
w AS (SELECT *, (c * c + s * s) / CASE WHEN 2 * k = n THEN 2 ELSE 1 END AS power FROM k),
share AS (SELECT p_brand, CAST(k AS INTEGER) AS cycles, CAST(n AS DOUBLE) / k AS season, power / sum(power) OVER (PARTITION BY p_brand) AS share FROM w)
"""


@query("periodogram", WEEKLY + POWER_SQL + "SELECT * FROM share", rounded="season share")
def _(spark, sf):
    return P.periodogram(by_brand_week(spark, sf), ["p_brand"])


# a season of 13 weeks is added, as the tables have none
@query("seasons", WEEKLY + POWER_SQL.replace("FROM panel)", """FROM (
  SELECT * REPLACE (qty + 2000 * sin(2 * pi() * (date_diff('week', DATE '1995-01-02', period) % 13) / 13) AS qty) FROM panel))""") + """,
m AS (SELECT *, 1 - power(0.05 / count(*) OVER (PARTITION BY p_brand), 1.0 / (count(*) OVER (PARTITION BY p_brand) - 1)) AS critical FROM share)
SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY round(share, 9) DESC, cycles) AS INTEGER) AS rank FROM m WHERE share > critical""",
       rounded="season share critical")
def _(spark, sf):
    week = F.floor(F.datediff("period", F.lit("1995-01-02").cast("date")) / 7)
    p = by_brand_week(spark, sf)
    p = p.withColumn("qty", F.col("qty") + 2000 * F.sin(2 * F.pi() * (week % 13) / 13))
    return P.seasons(durable(P.periodogram(p, ["p_brand"])), ["p_brand"])


@query("decompose_robust", rounded="trend seasonal_13 seasonal_52 weight remainder", digits=4)
def _(spark, sf):
    return P.decompose_robust(by_brand_week(spark, sf), ["p_brand"], "week", [13, 52])


@query("elastic_segments", rounded="distance", digits=4)
def _(spark, sf):
    return E.elastic_clusters(qty_panel(spark, sf), KEYS, 4, band=3, tries=1)[0]


# three shapes, each moved by up to four months: one peak, two peaks, and a peak with a dip behind it
@query("planted_elastic", PANEL + """,
m AS (SELECT p_brand, c_nationkey FROM panel GROUP BY ALL)
SELECT p_brand, c_nationkey, min(p_brand || '|' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) OVER (PARTITION BY c_nationkey % 3) AS cluster FROM m""")
def _(spark, sf):
    month = (F.year("period") - 1995) * 12 + F.month("period")
    t = month - (F.col("c_nationkey") * 7 + F.length("p_brand") + F.ascii(F.substring("p_brand", -1, 1))) % 5
    peak = lambda at: F.exp(-F.pow((t - at) / 3.0, 2))
    group = F.col("c_nationkey") % 3
    shape = F.when(group == 0, peak(20)).when(group == 1, peak(20) + peak(50)).otherwise(peak(20) - peak(50))
    p = qty_panel(spark, sf).withColumn("qty", 100 * shape + F.col("qty") / 1000)
    found = durable(E.elastic_clusters(p, KEYS, 3, band=5)[0])
    name = F.concat_ws("|", "p_brand", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    first = found.groupBy("cluster").agg(F.min(name).alias("first"))
    return found.join(first, "cluster").select(*KEYS, F.col("first").alias("cluster"))
