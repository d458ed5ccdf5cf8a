"""Density clusters on a grid, exactly as by all pairs (Ester et al. 1996), without making pairs.

Space is cut into cells whose points are all within ``eps`` of each other. A point with ``least`` points
around it, itself included, is a core point; core points within ``eps`` share a cluster, other points
within ``eps`` of a core point join the nearest, the rest is noise. In a cell of ``least`` points all are
core points, so only points of thin cells, fewer than ``least`` each, are counted against the cells
around them. Cells of core points are linked by one block of each first; cells that no chain of such
links joins are then compared block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.rows import whole_groups
from ..functions.runtime import durable

BLOCK = 1024


def _offsets(d: int) -> list[list[int]]:
    """Cells that can hold a point within eps of a point of a cell: the gap between them is shorter."""
    reach = int(np.ceil(np.sqrt(d)))
    return [list(o) for o in product(range(-reach, reach + 1), repeat=d) if sum(max(abs(i) - 1, 0) ** 2 for i in o) < d]


def _points(df: DataFrame, keys: list[str], cols: list[str], eps: float) -> DataFrame:
    """Stored id, name, x, cell of the rows that have all numbers."""
    d = len(cols)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    cell = F.transform(x, lambda v: F.floor(v / F.lit(eps / np.sqrt(d))))
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in cols]
    ok = whole[0]
    for c in whole[1:]:
        ok = ok & c
    named = df.where(ok).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("name"), x.alias("x"), cell.alias("cell"))
    # rows that repeat keys and numbers are told apart by their own number
    return durable(named.withColumn("id", F.monotonically_increasing_id()))


def _around(cell: str, d: int) -> Column:
    offsets = F.array(*[F.array(*[F.lit(i) for i in o]) for o in _offsets(d)])
    return F.explode(F.transform(offsets, lambda o: F.zip_with(F.col(cell), o, lambda a, b: a + b)))


UNIT = ["k1", "k2", "k3", "k4"]


def _pairs(units: DataFrame, schema: str, work: Callable) -> DataFrame:
    """``work(ids, points, ids, points, key)`` of both sides of every unit (k1…k4, side, id, x); a unit lies in one task."""
    sorted_units = units.select(*[F.col(k).cast("long").alias(k) for k in UNIT], "side", "id", "x").repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "id")
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, UNIT):
            side, ids, first = t["side"].to_numpy(), t["id"].to_numpy(), t["k1"].to_numpy()
            second = t["k2"].to_numpy()
            x = t["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            found = []
            for g in groups:
                middle = g.start + int(np.searchsorted(side[g], 1))
                if g.start < middle < g.stop:
                    a, b = slice(g.start, middle), slice(middle, g.stop)
                    found.append(work(ids[a], x[a], ids[b], x[b], (first[g.start], second[g.start])))
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], types.names)

    return sorted_units.mapInArrow(run, schema)


def _near(xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Squared distances; the parts of a block at a time."""
    return ((xa[:, None, :] - xb[None, :, :]) ** 2).sum(axis=2)


def _against(left: DataFrame, right: DataFrame, d: int) -> DataFrame:
    """Units of the points of a thin cell (side 0) and a block of points of a cell around it (side 1)."""
    n = right.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    thin = left.select("cell").distinct()
    meet = thin.select(F.col("cell").alias("home"), _around("cell", d).alias("cell")).join(n, "cell")
    key = [F.xxhash64("home").alias("k1"), F.xxhash64("cell").alias("k2"), F.col("block").alias("k3"), F.lit(0).alias("k4")]
    ones = meet.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(left.select(F.col("cell").alias("home"), "id", "x"), "home")
    twos = right.select("cell", "id", "x").join(meet, "cell").withColumn("block", block)
    part = lambda df, side: df.select(*key, F.lit(side).alias("side"), "id", "x")
    return part(ones, 0).unionByName(part(twos, 1))


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach. Every node takes the smallest root beside it, then its root's root, until none changes."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = durable(nodes.select("node", F.col("node").alias("root")))
    while True:
        beside = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hop = now.join(beside, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = durable(hop.join(jump, "root", "left").select("node", "was", F.coalesce("next", "root").alias("root")))
        now = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return now


def density_clusters(df: DataFrame, keys: list[str], cols: list[str], eps: float, least: int) -> DataFrame:
    """keys…, kind (core, border, noise) and cluster, the first name of its core points (null: noise).

    A name is the keys as JSON. Rows that lack a number are noise. Two to four columns: the number of
    cells around a cell grows with the power of their number.
    """
    d, eps2 = len(cols), eps * eps
    points = _points(df, keys, cols, eps)
    sizes = points.groupBy("cell").agg(F.count("*").alias("n"))
    sized = points.join(sizes, "cell")
    thin = durable(sized.where(F.col("n") < least).select("cell", "id", "x"))

    count = lambda ia, xa, ib, xb, _: (ia, (_near(xa, xb) <= eps2).sum(axis=1).astype("int64"))
    counts = _pairs(_against(thin, points, d), "id long, n long", count).groupBy("id").agg(F.sum("n").alias("n"))
    dense = sized.where(F.col("n") >= least).select("id")
    core_ids = dense.unionByName(counts.where(F.col("n") >= least).select("id"))
    core = durable(points.join(core_ids, "id"))

    # cells of core points that have two within eps, first by one block of each
    blocks = core.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("node")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    blocks = durable(blocks)
    other = blocks.select(F.col("cell").alias("cell2"), F.col("node").alias("b"), F.col("blocks").alias("blocks2"))
    beside = durable(blocks.select("cell", F.col("node").alias("a"), "blocks", _around("cell", d).alias("cell2")).join(other, "cell2").where("a < b"))
    placed = durable(core.join(blocks, "cell").select("cell", "id", "x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))

    def linked(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b, cell, cell2, i, j) whose blocks hold two points within eps."""
        key = [F.col(c).alias(k) for c, k in zip("abij", UNIT)]
        one = pairs.join(placed.withColumnRenamed("block", "i"), ["cell", "i"]).select(*key, F.lit(0).alias("side"), "id", "x")
        two = pairs.join(placed.withColumnRenamed("block", "j").withColumnRenamed("cell", "cell2"), ["cell2", "j"]).select(*key, F.lit(1).alias("side"), "id", "x")

        def touch(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray, cells: tuple) -> tuple:
            hit = any((_near(xa[k : k + 64], xb) <= eps2).any() for k in range(0, len(xa), 64))
            return tuple(np.full(int(hit), c, "int64") for c in cells)

        return durable(_pairs(one.unionByName(two), "a long, b long", touch).distinct())

    first = linked(beside.withColumns({"i": F.lit(0), "j": F.lit(0)}))
    roots = _components(blocks.select("node"), first)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = beside.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root AND (blocks > 1 OR blocks2 > 1)")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = apart.select("a", "b", "cell", "cell2", "blocks2", upto("blocks").alias("i")).withColumn("j", upto("blocks2")).where("i > 0 OR j > 0")
    second = linked(rest.drop("blocks2"))
    roots = durable(_components(blocks.select("node"), first.unionByName(second)))

    cells = blocks.select("cell", "node").join(roots, "node").select("cell", "root")
    core_rooted = core.join(cells, "cell")
    names = core_rooted.groupBy("root").agg(F.min("name").alias("cluster"))
    edge = thin.join(core_ids, "id", "left_anti")

    def closest(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray, _: tuple) -> tuple:
        order = np.argsort(ib)  # of equal ones the first point
        far = _near(xa, xb[order])
        at = far.argmin(axis=1)
        best = far[np.arange(len(ia)), at]
        near = best <= eps2
        return ia[near], best[near], ib[order][at[near]]

    joined = _pairs(_against(edge, core, d), "id long, far double, to long", closest)
    joined = joined.groupBy("id").agg(F.min(F.struct("far", "to"))["to"].alias("to"))
    border = joined.join(core_rooted.select(F.col("id").alias("to"), "root"), "to").select("id", F.lit("border").alias("kind"), "root")
    found = core_rooted.select("id", F.lit("core").alias("kind"), "root").unionByName(border).join(names, "root").select("id", "kind", "cluster")
    told = points.join(found, "id", "left").select("name", "x", F.coalesce("kind", F.lit("noise")).alias("kind"), "cluster").distinct()
    rows = df.withColumns({"_name": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), "_x": F.array(*[F.col(c).cast("double") for c in cols])})
    # a NaN is not equal to itself in a join of arrays, and such rows are noise anyway
    out = rows.join(told.select(F.col("name").alias("_name"), F.col("x").alias("_x"), "kind", "cluster"), ["_name", "_x"], "left")
    return out.select(*keys, F.coalesce("kind", F.lit("noise")).alias("kind"), "cluster")
