"""Sources, sinks and preprocessing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.runtime import scratch_path
from ..operators import panel as P
from ..sources.panel_store import read_panel, write_panel
from ..sources.sales import read_sales, read_sales_csv
from ..sources.tables import SCHEMAS, table
from .base import KEYS, PANEL, SALES_SQL, WHOLE, panel, sales, span_sql, sparse_panel, sparse_sql, whole_panel
from .registry import query

LINE_MAP = {
    "order_id": "l_orderkey", "item": "l_partkey", "store": "l_suppkey", "ds": "l_shipdate",
    "qty": "l_quantity", "revenue": "l_extendedprice", "promo": "l_discount",
}


@query("read_sales", """
SELECT l_orderkey AS order_id, l_partkey AS item, l_suppkey AS store, CAST(l_shipdate AS DATE) AS ds,
       l_quantity AS qty, l_extendedprice AS revenue, l_discount AS promo FROM lineitem""")
def _(spark, sf):
    return read_sales(spark, f"{sf}/lineitem.parquet", LINE_MAP, SCHEMAS["lineitem"])


@query("read_sales_csv", """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
       count(*) FILTER (WHERE l_tax > 0) AS good_lines, sum(l_quantity) FILTER (WHERE l_tax > 0) AS qty,
       count(*) FILTER (WHERE l_tax = 0) AS bad_lines FROM lineitem GROUP BY 1""")
def _(spark, sf):
    # Tax-free lines are written with an unreadable quantity, so they must all come back as rejects.
    path = scratch_path(spark, "csv")
    lines = table(spark, sf, "lineitem")
    broken = F.when(F.col("l_tax") == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_partkey", broken.alias("units")
    ).write.option("header", True).csv(path)
    good, bad = read_sales_csv(
        spark, path, "day date, l_partkey bigint, units double", {"ds": "day", "item": "l_partkey", "qty": "units"}
    )
    good = good.select(F.trunc("ds", "month").alias("period"), "qty", F.lit(0).alias("bad"))
    bad = bad.select(
        F.trunc(F.split("line", ",")[0].cast("date"), "month").alias("period"),
        F.lit(None).cast("double").alias("qty"),
        F.lit(1).alias("bad"),
    )
    return good.unionByName(bad).groupBy("period").agg(
        F.count_if(F.col("bad") == 0).alias("good_lines"),
        F.sum("qty").alias("qty"),
        F.count_if(F.col("bad") == 1).alias("bad_lines"),
    )


@query("write_panel", WHOLE + """
SELECT p_brand, c_nationkey, period, CASE WHEN year(period) = 1998 THEN 2 * qty ELSE qty END AS qty,
       CAST(year(period) AS INTEGER) AS bucket FROM whole""")
def _(spark, sf):
    # Write all years, then rerun one year with doubled demand: only its partition may change.
    path = scratch_path(spark, "panel")
    p = whole_panel(spark, sf).select(*KEYS, "period", "qty")
    write_panel(p, path)
    write_panel(p.where(F.year("period") == 1998).withColumn("qty", F.col("qty") * 2), path)
    return read_panel(spark, path, "p_brand string, c_nationkey int, period date, qty double, bucket int")


@query("dedupe_exact", "SELECT DISTINCT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return P.dedupe(lines.unionByName(lines)).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("dedupe_newest", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ds"), "o_totalprice"
    )
    return P.dedupe(o, keys=["o_custkey"], newest="ds")


@query("enrich_dims", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, p.p_brand, p.p_type, s.s_nationkey, n.n_name
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    dims = [
        (table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), {"l_partkey": "p_partkey"}),
        (table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), {"l_suppkey": "s_suppkey"}),
        (table(spark, sf, "nation").select("n_nationkey", "n_name"), {"s_nationkey": "n_nationkey"}),
    ]
    return P.enrich(lines, dims).select(
        "l_orderkey", "l_linenumber", "l_quantity", "p_brand", "p_type", "s_nationkey", "n_name"
    )


@query("demand_panel", f"""WITH {SALES_SQL}
SELECT 'week' AS freq, p_brand, c_nationkey, CAST(date_trunc('week', ds) AS DATE) AS period, sum(qty) AS qty,
       sum(CAST(round(qty * price * 100) AS BIGINT)) / 100.0 AS revenue, sum(qty * promo) / sum(qty) AS promo
FROM sales GROUP BY ALL
UNION ALL
SELECT 'month', p_brand, c_nationkey, CAST(date_trunc('month', ds) AS DATE), sum(qty),
       sum(CAST(round(qty * price * 100) AS BIGINT)) / 100.0, sum(qty * promo) / sum(qty)
FROM sales GROUP BY ALL
UNION ALL
SELECT 'day', p_brand, c_nationkey, ds, sum(qty),
       sum(CAST(round(qty * price * 100) AS BIGINT)) / 100.0, sum(qty * promo) / sum(qty)
FROM sales GROUP BY ALL""")
def _(spark, sf):
    return P.demand_panels(sales(spark, sf), KEYS, ["day", "week", "month"])


@query("densify", PANEL + " SELECT * FROM panel")
def _(spark, sf):
    return panel(spark, sf)


@query("densify_series", "WITH " + sparse_sql("l_partkey", "week") + """,
edge AS (SELECT max(period) AS last FROM sparse),
grid AS (
  SELECT l_partkey, CAST(unnest(generate_series(min(period), any_value(last), INTERVAL 7 DAY)) AS DATE) AS period
  FROM sparse, edge GROUP BY l_partkey)
SELECT g.l_partkey, g.period, coalesce(x.qty, 0.0) AS qty FROM grid g LEFT JOIN sparse x USING (l_partkey, period)""")
def _(spark, sf):
    # Item × week, each series from its own first sale.
    s = sparse_panel(spark, sf, ["l_partkey"], "week").select("l_partkey", "period", "qty")
    return P.densify(s, ["l_partkey"], "week", start="series")


@query("drop_partial", f"""WITH {SALES_SQL}, {span_sql('week')},
weekly AS (
  SELECT p_brand, CAST(date_trunc('week', ds) AS DATE) AS period, sum(qty) AS qty FROM sales GROUP BY ALL)
SELECT weekly.* FROM weekly, span WHERE period >= first_day AND period < end_day""")
def _(spark, sf):
    weekly = P.demand_panel(sales(spark, sf, ["p_brand"]), ["p_brand"], "week").select("p_brand", "period", "qty")
    days = table(spark, sf, "orders")
    lo = days.agg(F.min("o_orderdate").cast("date")).scalar()
    hi = days.agg(F.max("o_orderdate").cast("date")).scalar()
    return P.drop_partial(weekly, "week", lo, hi)


PRICED = PANEL.rstrip() + """,
priced AS (SELECT p_brand, c_nationkey, period, CASE WHEN qty > 0 THEN revenue / qty END AS price FROM panel),
near AS (
  SELECT *, max(CASE WHEN price IS NOT NULL THEN period END) OVER back AS p0,
         min(CASE WHEN price IS NOT NULL THEN period END) OVER ahead AS p1,
         last_value(price IGNORE NULLS) OVER back AS v0, first_value(price IGNORE NULLS) OVER ahead AS v1
  FROM priced WINDOW
    back AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    ahead AS (PARTITION BY p_brand, c_nationkey ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query("impute", PRICED + """
SELECT p_brand, c_nationkey, period, price, coalesce(price, 0.0) AS price_zero,
       coalesce(price, round(avg(price) OVER (PARTITION BY p_brand, c_nationkey), 6)) AS price_mean,
       v0 AS price_ffill, v1 AS price_bfill,
       coalesce(price, v0 + (v1 - v0) * date_diff('day', p0, period) / date_diff('day', p0, p1)) AS price_linear
FROM near""")
def _(spark, sf):
    p = panel(spark, sf).select(*KEYS, "period", ratio("revenue", "qty").alias("price"))
    for how in P.IMPUTE:
        p = P.impute(p, KEYS, "price", how, out=f"price_{how}")
    # only the mean depends on the order of addition
    return p.withColumn("price_mean", F.coalesce("price", F.round("price_mean", 6)))


@query("cap_outliers", PANEL + """,
q AS (SELECT p_brand, c_nationkey, quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3
      FROM panel GROUP BY ALL),
b AS (SELECT p.p_brand, p.c_nationkey, period, qty, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM panel p JOIN q USING (p_brand, c_nationkey))
SELECT p_brand, c_nationkey, period, qty, lo, hi, least(greatest(qty, lo), hi) AS qty_capped,
       (qty < lo OR qty > hi) AS capped FROM b""", rounded="lo hi qty_capped")
def _(spark, sf):
    return P.cap_outliers(panel(spark, sf).select(*KEYS, "period", "qty"), KEYS, "iqr", 1.5)


@query("cap_outliers_mad", PANEL + """,
m AS (SELECT p_brand, c_nationkey, quantile_cont(qty, 0.5) AS med FROM panel GROUP BY ALL),
d AS (SELECT p_brand, c_nationkey, any_value(med) AS med, quantile_cont(abs(qty - med), 0.5) AS mad
      FROM panel JOIN m USING (p_brand, c_nationkey) GROUP BY ALL),
b AS (SELECT p.p_brand, p.c_nationkey, period, qty, med - 3 * mad AS lo, med + 3 * mad AS hi
      FROM panel p JOIN d USING (p_brand, c_nationkey))
SELECT p_brand, c_nationkey, period, qty, lo, hi, least(greatest(qty, lo), hi) AS qty_capped,
       (qty < lo OR qty > hi) AS capped FROM b""", rounded="lo hi qty_capped")
def _(spark, sf):
    return P.cap_outliers(panel(spark, sf).select(*KEYS, "period", "qty"), KEYS, "mad", 3.0)


@query("resample", "WITH " + sparse_sql("p_brand", "day") + """
SELECT p_brand, CAST(date_trunc('month', period) AS DATE) AS period, sum(qty) AS qty, avg(revenue / qty) AS price
FROM sparse GROUP BY ALL""", rounded="price", digits=7)
def _(spark, sf):
    daily = sparse_panel(spark, sf, ["p_brand"], "day").withColumn("price", ratio("revenue", "qty"))
    return P.resample(daily, ["p_brand"], "month", {"qty": "sum", "price": "avg"})


@query("hierarchy_rollup", WHOLE + """
SELECT CAST(GROUPING(p_brand, c_nationkey) AS BIGINT) AS level_id,
       CASE GROUPING(p_brand, c_nationkey) WHEN 0 THEN 'p_brand_c_nationkey' WHEN 1 THEN 'p_brand'
            WHEN 2 THEN 'c_nationkey' ELSE 'total' END AS level,
       p_brand, c_nationkey, period, sum(qty) AS qty
FROM whole
GROUP BY GROUPING SETS ((period), (p_brand, period), (c_nationkey, period), (p_brand, c_nationkey, period))""")
def _(spark, sf):
    return P.hierarchy(whole_panel(spark, sf), [[], ["p_brand"], ["c_nationkey"], KEYS])


def _column_sql(c: str, numeric: bool) -> str:
    neg = f"count(*) FILTER (WHERE {c} < 0)" if numeric else "CAST(NULL AS BIGINT)"
    return (
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
        f"{neg} AS negatives, count(DISTINCT {c}) AS distinct_values FROM lineitem"
    )


# all columns; those of numbers also report negatives
REPORTED = {name: kind in ("bigint", "int", "double") for name, kind in (c.split() for c in SCHEMAS["lineitem"].split(", "))}


@query("quality_report", "\nUNION ALL\n".join(_column_sql(c, n) for c, n in REPORTED.items()))
def _(spark, sf):
    return P.column_report(table(spark, sf, "lineitem"), list(REPORTED))


@query("quality_gaps", WHOLE + """
SELECT p_brand, c_nationkey, min(period) AS first_period, max(period) AS last_period, count(*) AS n_rows,
       CAST(date_diff('month', min(period), max(period)) + 1 - count(*) AS BIGINT) AS gaps
FROM whole GROUP BY ALL""")
def _(spark, sf):
    return P.gap_report(whole_panel(spark, sf), KEYS, "month")


@query("time_split", PANEL + """
SELECT p_brand, c_nationkey, period, qty, CASE WHEN period < DATE '2000-01-01' THEN 'train'
       WHEN period < DATE '2001-01-01' THEN 'valid' ELSE 'test' END AS split FROM panel""")
def _(spark, sf):
    return P.time_split(
        panel(spark, sf).select(*KEYS, "period", "qty"), dt.date(2000, 1, 1), dt.date(2001, 1, 1)
    )
