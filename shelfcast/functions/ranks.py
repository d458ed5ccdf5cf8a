"""Running totals and exact quantiles of groups of any size.

A window over a group needs the group in one task. Here rows are range-partitioned by
(group, order) instead, so one group may span many tasks: each task sums its slice, the slice sums
(one row per group and slice) give the offsets, and the window runs inside a slice only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .runtime import durable


def running_total(
    df: DataFrame, by: list[str], order: list[Column], value: str, *, before: str = "before", total: str = "total"
) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the group, and the group's total.

    ``order`` must order the rows of a group fully. The slices are stored once, since both passes
    must see the same ones.
    """
    # AQE may merge neighbouring slices of little data; their order stays
    ranged = durable(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_slice").agg(F.sum(value).alias("_sum"))
    per_group = W.partitionBy(*by) if by else W.partitionBy()
    offsets = sums.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.col("_slice").alias("_s"),
        F.sum("_sum").over(per_group).alias(total),
        (F.sum("_sum").over(per_group.orderBy("_slice")) - F.col("_sum")).alias("_offset"),
    )
    match = [F.col("_slice") == F.col("_s")]
    match += [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    inside = W.partitionBy("_slice", *by).orderBy(*order)
    return (
        ranged.join(offsets, reduce(lambda a, b: a & b, match))
        .withColumn(before, F.col("_offset") + F.sum(value).over(inside) - F.col(value))
        .drop("_slice", "_s", "_offset", *[f"_g{i}" for i in range(len(by))])
    )


def exact_quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles; nulls are left out.

    Equal values are counted before the shuffle, so a value that fills a third of the rows is one row.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, by, [F.col("_v")], "_n", before="_before", total="_total")
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{end}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_{name}_part"))
    out = ranked.groupBy(*by).agg(*picks, F.max("_total").alias("_total"))
    value = lambda n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")
    return out.select(*by, F.col("_total").alias("n_rows"), *[value(n).alias(n) for n in probs])
