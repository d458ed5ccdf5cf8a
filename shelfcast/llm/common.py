"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.runtime import durable

#: A word: a run of bytes that are not ASCII white space. bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(docs: DataFrame, keep: list[str], text: str, schema: str, compute: Callable[[list[str | None]], dict]) -> DataFrame:
    """The ``keep`` columns as they are and what ``compute`` makes of the texts of a batch: a list per column of ``schema``.

    Texts are read whole and where they lie, without a shuffle. ``text`` may be a field of a kept
    struct column (``row.text``): it then travels once.
    """
    inner = text.split(".", 1) if "." in text and text.split(".")[0] in keep else None
    added = StructType.fromDDL(schema)
    types, whole = to_arrow_schema(added), StructType([*(docs.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(keep)]
            texts = columns[keep.index(inner[0])].field(inner[1]) if inner else batch.column(len(keep))
            found = compute(texts.to_pylist())
            made = [x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*keep, *types.names])

    read = [] if inner else [F.col(f"`{text}`").alias("_text")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], *read).mapInArrow(run, whole)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by the whole numbers ``by`` as tables of one chunk that part no group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        other = np.flatnonzero(np.any([(v := held[c].to_numpy()) != v[-1] for c in by], axis=0))
        if len(other):  # the last group may go on in the next batch
            cut = int(other[-1]) + 1
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case. The bytes methods touch ASCII only, as asked."""
    return text.encode().lower().split() if text else []


def ranked(df: DataFrame, by: list[str], key: list[Column], rank: str = "rank", rows_per_slice: int = 100_000) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by a hash of ``key``.

    A group may hold any share of the rows: it is cut into slices of its hash range, the slice
    counts give offsets, and the numbering runs inside a slice. Only rows with equal ``key`` are
    never parted. ``by`` columns must not be null. ``df`` is read twice and must be stored.
    """
    hashed = df.withColumn("_h", F.xxhash64(*key))
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    slices = -(-most // rows_per_slice) or 1
    # the top 31 bits of the hash, scaled to the number of slices, so slices are in hash order
    cut = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(2**63))), 33) * F.lit(slices)
    hashed = hashed.withColumn("_s", F.shiftright(cut, 31).cast("int"))
    inside = W.partitionBy(*by, "_s").orderBy("_h")
    numbered = hashed.withColumn("_r", F.row_number().over(inside) - 1)
    if slices == 1:
        return numbered.withColumn(rank, F.col("_r").cast("long")).drop("_h", "_s", "_r")
    counts = hashed.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_s")) - F.col("_n")).drop("_n")
    return (
        numbered.join(offsets, [*by, "_s"])
        .withColumn(rank, F.col("_before") + F.col("_r"))
        .drop("_h", "_s", "_r", "_before")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root), root being the smallest node reached; nodes are those of edges.

    Alternates two star steps until nothing changes: each node sends its larger neighbours, then its
    smaller ones and itself, to its smallest neighbour. Each step is two aggregates or joins by node,
    so a hub's edges are never in one task, and the number of edges does not grow. Every step is
    stored in the shared folder.
    """
    now = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    while True:
        # large star: larger neighbours go to the smallest of the node's neighbours and itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself go to the smallest of them
        large = durable(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        after = durable(small.where("u <> v").distinct())
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        now = after
        if same:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
