"""A demand panel kept up to date from a stream of sales files.

Every micro-batch is added up to increments, one row per series and period that it touches, stored
under its batch number. Then the touched periods, and no others, are added up anew from all increments
and replace their partitions of the panel. Late sales are therefore no special case: they touch an old
period, and its partition is replaced. A batch that runs again after a failure writes the same
increments over its own and the same partitions, so nothing counts twice.

Sales that are delivered twice can be dropped by an id within a watermark; ids are kept as state until
the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.columns import period_of


def increments(batch: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """keys…, period, qty, sales (rows) of a batch with ds and qty; rows without a date belong to no period and go."""
    rows = batch.where(F.col("ds").isNotNull()).withColumn("period", period_of("ds", freq))
    return rows.groupBy(*keys, "period").agg(F.sum("qty").alias("qty"), F.count("*").alias("sales"))


def month_of(period: str = "period") -> Column:
    """The partition of a period: its month, so that there are few folders whatever the frequency."""
    return F.date_format(period, "yyyy-MM")


class PanelKeeper:
    """Folders of a panel: ``<path>/increments`` by batch and month, ``<path>/panel`` by month."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], freq: str):
        self.spark, self.path, self.keys, self.freq = spark, path.rstrip("/"), keys, freq

    def _write(self, df: DataFrame, folder: str, *by: str) -> None:
        # only the partitions that the rows belong to are replaced
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{folder}")

    def _read(self, folder: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take one batch in. The same batch under the same number changes nothing the second time."""
        new = increments(batch, self.keys, self.freq).withColumns({"month": month_of(), "batch": F.lit(number).cast("long")})
        self._write(new, "increments", "batch", "month")
        stored = self._read("increments", new.schema)
        # the months of the batch: at most as many as its rows span, and they prune the folders that are read
        touched = [r.month for r in stored.where(F.col("batch") == number).select("month").distinct().collect()]
        if touched:
            own = stored.where(F.col("month").isin(touched))
            anew = own.groupBy(*self.keys, "period", "month").agg(F.sum("qty").alias("qty"), F.sum("sales").alias("sales"))
            self._write(anew, "panel", "month")

    def follow(self, stream: DataFrame, checkpoint: str, id: list[str] | None = None, late: str = "30 days", **trigger) -> StreamingQuery:
        """Start to take in a stream of sales (keys…, ds, qty and the columns of ``id``).

        With ``id`` a sale that comes again within ``late`` of the newest date is dropped. By default all
        files that are there are taken in, in as many batches as the source makes, and the query ends.
        """
        if id:
            stream = stream.withColumn("_at", F.col("ds").cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(id).drop("_at")
        return (
            stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def panel(self, schema: StructType) -> DataFrame:
        """keys…, period, qty, sales as they are now; ``schema`` is that of the sales."""
        fields = StructType([*(schema[k] for k in self.keys)]).add("period", "date").add("qty", "double").add("sales", "long").add("month", "string")
        return self._read("panel", fields).drop("month")


def sales_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
