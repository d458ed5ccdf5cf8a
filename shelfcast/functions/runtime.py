"""Shared storage, lineage cuts and size-checked reads."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, Row, SparkSession


class TooLarge(ValueError):
    """A side that must stay small is larger than its bound."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` or by ``SparkContext.setCheckpointDir``.

    There is no other choice: a folder of the driver's machine would be lost with it, and the
    executors would not see it. Tests and benchmarks set one of their own.
    """
    folder = _named_folder(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def has_checkpoint_dir(spark: SparkSession) -> bool:
    return bool(_named_folder(spark))


def _named_folder(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a command go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Used where several passes follow: they read columns instead of repeating the work, and a lost
    executor costs a re-read, not a re-run. With ``tidy`` the shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(stored: DataFrame) -> None:
    """Remove a table that ``durable`` returned; nothing that is still to run may read it."""
    sc = stored.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(stored._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list[Row]:
    """All rows of a frame that must be small; raises instead of taking a part of them."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise TooLarge(f"{what}: more than {bound} rows")
    return rows


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers of this application, once.

    They must not depend on the folder in which the driver was started. The archive goes through the
    shared folder, if there is one, and Spark hands it to every worker.
    """
    sc = spark.sparkContext
    if getattr(sc, "_shelfcast_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/shelfcast-{uuid.uuid4().hex}.zip"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._shelfcast_shipped = True
