"""Canonical sales and panels over the star-schema tables, in Spark and as oracle CTEs.

Demand is line quantity on the order date. Series are brand × customer nation unless stated. A
discount of 5 % or more stands in for a promotion; price is the line price per unit.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import first_full_period, full_period_end
from ..operators.panel import demand_panel, densify, enrich
from ..sources.tables import table

KEYS = ["p_brand", "c_nationkey"]
ZERO = {"qty": 0.0, "revenue": 0.0, "promo": 0.0}


def order_span(spark: SparkSession, sf_dir: str, freq: str) -> tuple[Column, Column]:
    """First full period and first day after the last one.

    Two dates from one pass over one column, fetched ahead: as literals they reach the file scans of
    everything that follows.
    """
    row = table(spark, sf_dir, "orders").agg(
        first_full_period(F.min("o_orderdate"), freq).alias("lo"), full_period_end(F.max("o_orderdate"), freq).alias("hi")
    ).first()
    return F.lit(row.lo), F.lit(row.hi)


def sales(
    spark: SparkSession, sf_dir: str, keys: list[str] = KEYS, span: tuple[Column, Column] | None = None
) -> DataFrame:
    """Canonical sales, all or from the first day of ``span`` to before its second.

    Only the tables that the keys need are joined, and only the columns in use are read.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if span:
        lo, hi = span
        orders = orders.where((F.col("o_orderdate") >= lo.cast("timestamp_ntz")) & (F.col("o_orderdate") < hi.cast("timestamp_ntz")))
    lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    dims = []
    if any(k.startswith("p_") for k in keys):
        part = table(spark, sf_dir, "part").select("p_partkey", *[k for k in keys if k.startswith("p_")])
        dims.append((part, {"l_partkey": "p_partkey"}))
    if any(k.startswith("c_") for k in keys):
        customer = table(spark, sf_dir, "customer").select("c_custkey", *[k for k in keys if k.startswith("c_")])
        dims.append((customer, {"o_custkey": "c_custkey"}))
    return enrich(lines, dims).select(
        *keys,
        F.col("o_orderdate").cast("date").alias("ds"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_discount") >= 0.05).cast("double").alias("promo"),
    )


def sparse_panel(
    spark: SparkSession, sf_dir: str, keys: list[str] = KEYS, freq: str = "month", span: tuple[Column, Column] | None = None
) -> DataFrame:
    """Full periods only, rows only where something was sold."""
    return demand_panel(sales(spark, sf_dir, keys, span or order_span(spark, sf_dir, freq)), keys, freq)


def whole_panel(spark: SparkSession, sf_dir: str, keys: list[str] = KEYS, freq: str = "month") -> DataFrame:
    """Every sale, also those of partial first and last periods; rows only where something was sold."""
    return demand_panel(sales(spark, sf_dir, keys), keys, freq)


def panel(spark: SparkSession, sf_dir: str, keys: list[str] = KEYS, freq: str = "month") -> DataFrame:
    """Dense panel from the first to the last full period."""
    sparse, (first, last) = panel_and_span(spark, sf_dir, keys, freq)
    return densify(sparse, keys, freq, start=first, end=last, fill=ZERO)


def panel_and_span(spark: SparkSession, sf_dir: str, keys: list[str], freq: str) -> tuple[DataFrame, tuple[Column, Column]]:
    """The sparse panel, and the first and the last full period."""
    lo, hi = order_span(spark, sf_dir, freq)
    last = F.date_add(hi, -1)
    return sparse_panel(spark, sf_dir, keys, freq, (lo, hi)), (lo, F.trunc(last, freq) if freq != "day" else last)


def by_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir, ["p_brand"], "week")


# ---- oracle text -----------------------------------------------------------------------------

SALES_SQL = """sales AS (
  SELECT p.p_brand, c.c_nationkey, l.l_partkey, CAST(o.o_orderdate AS DATE) AS ds, l.l_quantity AS qty,
         l.l_extendedprice / l.l_quantity AS price,
         CASE WHEN l.l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS promo
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  LEFT JOIN part p ON p.p_partkey = l.l_partkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""


def span_sql(freq: str) -> str:
    return f"""span AS (
  SELECT CASE WHEN date_trunc('{freq}', lo) = lo THEN CAST(date_trunc('{freq}', lo) AS DATE)
              ELSE CAST(date_trunc('{freq}', lo) + INTERVAL 1 {freq.upper()} AS DATE) END AS first_day,
         CAST(date_trunc('{freq}', hi + 1) AS DATE) AS end_day
  FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))"""


def sparse_sql(keys: str = "p_brand, c_nationkey", freq: str = "month") -> str:
    return f"""{SALES_SQL},
{span_sql(freq)},
sparse AS (
  SELECT {keys}, CAST(date_trunc('{freq}', ds) AS DATE) AS period, sum(qty) AS qty,
         sum(CAST(round(qty * price * 100) AS BIGINT)) / 100.0 AS revenue,
         sum(qty * promo) / sum(qty) AS promo
  FROM sales, span WHERE ds >= first_day AND ds < end_day GROUP BY ALL)"""


def whole_sql(keys: str = "p_brand, c_nationkey", freq: str = "month") -> str:
    return f"""{SALES_SQL},
whole AS (
  SELECT {keys}, CAST(date_trunc('{freq}', ds) AS DATE) AS period, sum(qty) AS qty,
         sum(CAST(round(qty * price * 100) AS BIGINT)) / 100.0 AS revenue
  FROM sales GROUP BY ALL)"""


def panel_sql(keys: str = "p_brand, c_nationkey", freq: str = "month") -> str:
    return f"""{sparse_sql(keys, freq)},
calendar AS (
  SELECT CAST(unnest(generate_series(first_day, end_day - INTERVAL 1 DAY, INTERVAL 1 {freq.upper()})) AS DATE) AS period
  FROM span),
panel AS (
  SELECT s.*, c.period, coalesce(x.qty, 0.0) AS qty, coalesce(x.revenue, 0.0) AS revenue,
         coalesce(x.promo, 0.0) AS promo
  FROM (SELECT DISTINCT {keys} FROM sparse) s CROSS JOIN calendar c
  LEFT JOIN sparse x USING ({keys}, period))"""


PANEL = "WITH " + panel_sql()
SPARSE = "WITH " + sparse_sql()
WHOLE = "WITH " + whole_sql()
WEEKLY = "WITH " + panel_sql("p_brand", "week")


def materialized(sql: str) -> str:
    """The SQL with every named part worked out once, whatever the optimiser makes of its size."""
    return re.sub(r"(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", sql)


def date_lit(text: str) -> Column:
    return F.lit(dt.date.fromisoformat(text))
