"""Register a query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Decorator. The columns named in ``rounded`` are rounded alike on both sides.

    Both engines add doubles in their own order, so sums and statistics differ in the last bits;
    exact columns are left as they are.
    """
    cols = rounded.split()

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) for c in cols}) if cols else df

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            # + 0.0 turns a rounded -0.0 into 0.0
            swap = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({swap}) FROM (\n{sql}\n) AS q" if cols else sql
        return fn

    return register
