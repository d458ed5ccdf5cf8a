"""The panel of all sales, taken in as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import scratch_path
from ..streaming.upkeep import PanelKeeper, sales_stream
from .base import KEYS, WHOLE, sales
from .registry import query


@query("panel_stream", WHOLE + """
SELECT p_brand, c_nationkey, CAST(date_trunc('month', ds) AS DATE) AS period, sum(qty) AS qty, count(*) AS sales FROM sales GROUP BY ALL""")
def _(spark, sf):
    rows = sales(spark, sf).select(*KEYS, "ds", "qty")
    # six files without any order of dates, taken in by two
    folder = scratch_path(spark, "sales")
    rows.repartition(6, F.xxhash64("ds", "qty", *KEYS)).write.parquet(folder)
    keeper = PanelKeeper(spark, scratch_path(spark, "kept"), KEYS, "month")
    query = keeper.follow(sales_stream(spark, folder, rows.schema, 2), scratch_path(spark, "progress"))
    query.awaitTermination()
    return keeper.panel(rows.schema)
