import datetime as dt
import random

import pytest

from shelfcast.functions.runtime import scratch_path
from shelfcast.streaming.upkeep import PanelKeeper, increments, sales_stream

SCHEMA = "s string, ds date, qty double, id long"


def some_sales(n=300, seed=1):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(5)}" if rng.random() > 0.05 else None, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(200)), float(rng.randrange(9)), i) for i in range(n)]


def now(panel):
    return sorted(map(str, ((r.s, r.period, r.qty, r.sales) for r in panel.collect())))


@pytest.mark.parametrize("cuts", [[300], [1, 2, 150, 151, 300], [100, 100, 200, 300]])
@pytest.mark.parametrize("freq", ["month", "week"])
def test_any_split_gives_the_panel_of_all(spark, cuts, freq):
    rows = some_sales()
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    keeper = PanelKeeper(spark, scratch_path(spark, "kept"), ["s"], freq)
    start = 0
    for number, end in enumerate(cuts):
        keeper.add(frame(rows[start:end]), number)
        if number == 1:  # a batch that runs again
            keeper.add(frame(rows[start:end]), number)
        start = end
    assert now(keeper.panel(frame(rows).schema)) == now(increments(frame(rows), ["s"], freq))


def test_stream_of_files_goes_on_where_it_ended(spark):
    rows = some_sales(200, 2)
    folder, progress = scratch_path(spark, "sales"), scratch_path(spark, "progress")
    frame = spark.createDataFrame(rows, SCHEMA)
    keeper = PanelKeeper(spark, scratch_path(spark, "kept"), ["s"], "month")
    for part in (frame.where("id < 120"), frame.where("id >= 120")):
        part.repartition(3).write.mode("append").parquet(folder)
        keeper.follow(sales_stream(spark, folder, frame.schema, 1), progress).awaitTermination()
        done = frame if part is not frame and part.where("id >= 120").count() else frame.where("id < 120")
        assert now(keeper.panel(frame.schema)) == now(increments(done, ["s"], "month"))


def test_sales_that_come_twice_are_dropped(spark):
    rows = some_sales(100, 3)
    folder = scratch_path(spark, "sales")
    spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(1).write.parquet(folder)
    frame = spark.createDataFrame(rows, SCHEMA)
    keeper = PanelKeeper(spark, scratch_path(spark, "kept"), ["s"], "month")
    keeper.follow(sales_stream(spark, folder, frame.schema), scratch_path(spark, "progress"), ["id"], late="400 days").awaitTermination()
    assert now(keeper.panel(frame.schema)) == now(increments(frame, ["s"], "month"))


def test_rows_without_a_date(spark):
    assert increments(spark.createDataFrame([("a", None, 1.0, 1)], SCHEMA), ["s"], "month").count() == 0
