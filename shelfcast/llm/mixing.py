"""Mixing sources to target weights by entropy balancing.

Rates r stay as near to 1 (in relative entropy) as the token constraints allow: minimise the sum of
r·log r − r over all documents such that the rates times the sizes of a source add up to its target
and no rate is above a cap. The dual has one multiplier per source, and the rates are
r = min(cap, exp(λ · size / mean size)). Newton steps on the log of the constraint find λ; they
work on counts per (source, size), which hold all that the dual needs, in Spark. Then rates become
whole copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.runtime import durable
from .common import WORD, ranked, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3


def size_of(text: str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def pick_order(doc_id: str, text: str) -> Column:
    """A hash that decides which documents of equal source and size get one more copy."""
    return F.xxhash64(F.col(doc_id), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add weight and target to (source, source_size).

    Sources sorted by code point, null last, take the weights in turn. Together the targets are all
    sizes; a target above ``cap`` times its source's size is cut to that, and the excess goes to the
    others by weight, until none is above. One row per source; sums of them are all the driver sees.
    """
    # strings compare by bytes of UTF-8, that is by code point; one row per source and no other column
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    known = durable(sources.withColumn("weight", weight))
    top = F.lit(float(cap)) * F.col("source_size")
    level, before = 0.0, -1
    while True:
        held = F.lit(level) * F.col("weight") >= top
        r = known.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(held, top)).alias("held"),
            F.sum(F.when(~held, F.col("weight"))).alias("free"),
            F.count(F.when(held, 1)).alias("n"),
        ).first()
        if r["n"] == before or not r["free"]:
            break
        # the level only rises, so a source that is held stays held
        before, level = r["n"], (r["all"] - (r["held"] or 0.0)) / r["free"]
    return known.withColumn("target", F.least(F.lit(level) * F.col("weight"), top))


def solve(cells: DataFrame, cap: float = CAP, close: float = 1e-9, steps: int = 60) -> DataFrame:
    """λ per source for cells (source, size, n, mean, target) with size above 0: (source, lam).

    Newton on log(sum of tokens) − log(target), which is concave and rising in λ below the cap; a
    bracket catches steps that leave it. The multipliers of a step are a stored table, one row per source.
    """
    z = F.col("size") / F.col("mean")
    # at hi every rate is at the cap; below lo the longest documents have no weight that a double shows
    now = cells.groupBy("source").agg(F.lit(0.0).alias("lam"), (F.lit(math.log(cap)) / F.min(z)).alias("hi"), F.lit(-1e6).alias("lo"))
    now = durable(now.withColumn("off", F.lit(1.0)))
    for _ in range(steps):
        rate = F.exp(F.least(F.col("lam") * z, F.lit(math.log(cap))))
        tokens = F.col("n") * F.col("size") * rate
        free = F.col("lam") * z < math.log(cap)
        sums = (
            cells.alias("c").join(now.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy("c.source")
            .agg(
                F.sum(tokens).alias("f"), F.sum(F.when(free, tokens * z).otherwise(0.0)).alias("slope"),
                *[F.first(c).alias(c) for c in ("target", "lam", "lo", "hi")],
            )
        )
        off = F.log(F.col("f")) - F.log(F.col("target"))
        moved = sums.withColumns({
            "off": off,
            "lo": F.when(off < 0, F.col("lam")).otherwise(F.col("lo")),
            "hi": F.when(off > 0, F.col("lam")).otherwise(F.col("hi")),
        })
        step = F.col("lam") - F.col("off") * F.col("f") / F.col("slope")
        # halving an interval that spans many powers of ten would be slow: lengthen the step instead
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        middle = F.when(F.col("lo") <= -1e6, F.col("lam") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = durable(moved.select(
            "source", F.when(F.abs("off") <= close, F.col("lam")).when(inside, step).otherwise(middle).alias("lam"), "hi", "lo", F.abs("off").alias("off")
        ))
        if (now.agg(F.max("off")).first()[0] or 0.0) <= close:
            break
    return now.select("source", "lam")


def whole_copies(cells: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Copies of each size of one source, so that the words taken come near the sum of those wished.

    From the largest size to the smallest each takes the whole number under or over n · rate that
    leaves least behind. What is left then is made up by single copies, the fitting size first.
    """
    cells = cells.sort_values("size", ascending=False)
    size, n, wish = (cells[c].to_numpy("float64") for c in ("size", "n", "wish"))
    copies, behind = n.copy(), 0.0
    for i in range(len(cells)):
        if size[i]:
            behind += wish[i] * size[i]
            copies[i] = min(max(round(behind / size[i]), math.floor(wish[i] + 1e-9)), math.ceil(wish[i] - 1e-9))
            behind -= copies[i] * size[i]
    while len(cells):
        sign = 1 if behind > 0 else -1
        may = (size > 0) & ((copies < cap * n) if sign > 0 else (copies > 0))
        after = np.where(may, np.abs(behind - sign * size), np.inf)
        i = int(after.argmin())
        if after[i] >= abs(behind) - 1e-9:
            break
        copies[i] += sign
        behind -= sign * size[i]
    return cells.assign(copies=copies.astype("int64")).drop(columns="wish")


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Copies for stored documents (source, size, pick): one row per (source, size).

    Returns source, size, source_size, target, base, last. A document of the cell is taken ``base``
    times, and once more if its ``pick`` is at most ``last`` (null: none). Rates are rounded per source;
    a group there has a row per distinct size, at most the square root of twice the source's words.
    Documents of size 0 keep one copy.
    """
    cells = durable(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"))
    per = targets(per, weights, cap).withColumn("mean", F.greatest(F.col("source_size") / F.col("rows"), F.lit(1e-9)))
    cells = durable(
        cells.alias("c").join(per.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
        .select("c.source", "size", "n", "source_size", "target", "mean")
    )
    lam = solve(cells.where("size > 0"), cap)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(
        F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))
    )
    # at the cap exp(log 3) is not quite 3
    rate = F.when(F.abs(rate - cap) < 1e-9, float(cap)).otherwise(rate)
    rated = cells.alias("c").join(lam.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left").select(
        "c.source", "size", "n", "source_size", "target", (F.col("n") * rate).alias("wish")
    )
    schema = "source string, size long, n long, source_size long, target double, copies long"
    rounded = rated.groupBy("source").applyInPandas(lambda cells: whole_copies(cells, cap), schema)
    counted = durable(
        rounded.withColumn("base", F.floor(F.col("copies") / F.col("n")).cast("long"))
        .withColumn("more", F.col("copies") - F.col("base") * F.col("n"))
        .select("source", "size", "source_size", "target", "base", "more", F.xxhash64("source").alias("_sid"))
    )
    # positions by pick in cells that give some of their documents one more copy
    rows = sized.select(F.col("size").alias("_size"), "pick", F.col("source").alias("_source"))
    some = rows.join(counted.where("more > 0"), F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")))
    some = durable(some.select("source", F.xxhash64("source").alias("_sid"), "size", "pick", "more"))
    # the slices of ``ranked`` order by a hash of pick, which decides just as well
    order = F.xxhash64("pick")
    taken = ranked(some, ["_sid", "size"], [F.col("pick")], "_at").where("_at < more")
    last = taken.groupBy(F.col("_sid").alias("_k"), F.col("size").alias("_z")).agg(F.max(order).alias("last"))
    return durable(
        counted.join(last, (F.col("_sid") == F.col("_k")) & (F.col("size") == F.col("_z")), "left")
        .select("source", "size", "source_size", "target", "base", "last")
    )


def copies_of(docs: DataFrame, planned: DataFrame, source: str, size: str, pick: str) -> DataFrame:
    """Join documents to their cell and add source_size, target and copies."""
    p = planned.select(*[F.col(c).alias(f"_p_{c}") for c in planned.columns])
    extra = F.coalesce((F.xxhash64(pick) <= F.col("_p_last")).cast("long"), F.lit(0))
    return (
        docs.join(p, F.col(source).eqNullSafe(F.col("_p_source")) & (F.col(size) == F.col("_p_size")))
        .withColumns({"source_size": F.col("_p_source_size"), "target": F.col("_p_target"), "copies": F.col("_p_base") + extra})
        .drop(*p.columns)
    )


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, pick)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), pick_order(doc_id, text).alias("pick"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(sized(table(spark, sf_dir, "documents")))
    out = copies_of(rows, plan(rows), "source", "size", "pick")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
