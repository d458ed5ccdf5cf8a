"""Minimum-trace reconciliation: forecasts of all levels of a hierarchy, made to add up with least error.

Every level is forecast on its own. Bottom-up reconciliation uses the leaves alone, top-down the total
alone; minimum trace (Wickramasuriya, Athanasopoulos & Hyndman 2019) uses all of them, each with the
variance of its past errors. With a diagonal error matrix the leaves become

    b + W U' (V + U W U')^-1 (u - U b)

where b and u are the forecasts of leaves and upper nodes, W and V their variances and U says which
leaf is under which node. U is never made: a leaf's upper nodes follow from its keys. The system has a
row per upper node and is sparse; it is added up by Spark from the leaves. A small one is solved at
once, a larger one by conjugate gradients over its table, for all periods together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.runtime import durable
from .forecast import residuals
from .panel import hierarchy

#: Upper nodes up to which the system is solved by the driver.
DENSE = 2000
#: Rounds of conjugate gradients at most, and the share of the first error at which they end.
ROUNDS, PRECISION = 500, 1e-11


def node_of(level: list[str]) -> Column:
    """The name of a node: its keys and their values as JSON, {} for the total."""
    return F.to_json(F.struct(*[F.col(c) for c in level]), {"ignoreNullFields": "false"}) if level else F.lit("{}")


def node_panel(panel: DataFrame, levels: list[list[str]]) -> DataFrame:
    """node, period, qty: the demand of every node of every level."""
    rows = [panel.groupBy(*level, "period").agg(F.sum("qty").alias("qty")).select(node_of(level).alias("node"), "period", "qty") for level in levels]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def variances(past: DataFrame, least: float = 1e-6) -> DataFrame:
    """(node, var): mean squared error of past forecasts that were made with actuals; at least ``least``."""
    e = F.col("residual")
    return residuals(past).groupBy("node").agg(F.greatest(F.avg(e * e), F.lit(least)).alias("var"))


def min_trace(base: DataFrame, var: DataFrame, leaves: DataFrame, levels: list[list[str]], dense: int = DENSE) -> DataFrame:
    """Reconciled forecasts of every level: level_id, level, keys…, period, yhat.

    ``base`` has node, period and yhat, ``var`` node and var, ``leaves`` the keys of all leaves; the
    last of ``levels`` has all keys. Upper nodes that lack a forecast of some period, or a variance,
    take the sum of their leaves; leaves without a forecast count as 0, and without a variance as
    certain.
    """
    keys, upper = levels[-1], levels[:-1]
    rows = base.join(var, "node", "left")
    periods = base.select("period").distinct()
    # the few future periods are listed in the row: no join by them
    listed = F.sort_array(F.collect_list(F.struct("period", "yhat")))
    told = rows.groupBy("node").agg(listed.alias("f"), F.count("yhat").alias("n"), F.first("var").alias("var"))
    leaf = leaves.select(*keys).distinct().withColumn("node", node_of(keys)).join(told, "node", "left")
    of = F.array(*[node_of(level) for level in upper])
    leaf = durable(leaf.select(*keys, "node", F.coalesce("var", F.lit(0.0)).alias("var"), F.col("f"), of.alias("upper")))
    flat = leaf.select("node", "var", "upper", F.explode("f").alias("f")).select("node", "var", "upper", "f.period", F.coalesce("f.yhat", F.lit(0.0)).alias("yhat"))

    steps = periods.count()
    used = told.where((F.col("n") == steps) & F.col("var").isNotNull()).select("node", "var", "f")
    below = flat.select(F.explode("upper").alias("node"), "period", "yhat").groupBy("node", "period").agg(F.sum("yhat").alias("sum"))
    own = used.select("node", "var", F.explode("f").alias("f")).select("node", "var", "f.period", "f.yhat")
    gap = durable(own.join(below, ["node", "period"]).select("node", "period", "var", (F.col("yhat") - F.col("sum")).alias("gap")))

    known = gap.select("node", "var").distinct()
    pairs = leaf.select("var", F.explode("upper").alias("a"), "upper").select("var", "a", F.explode("upper").alias("b"))
    both = pairs.groupBy("a", "b").agg(F.sum("var").alias("v"))
    own_var = known.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("var").alias("v"))
    inside = lambda c: known.select(F.col("node").alias(c))
    matrix = durable(both.join(inside("a"), "a").join(inside("b"), "b").unionByName(own_var).groupBy("a", "b").agg(F.sum("v").alias("v")))
    pull = solve(matrix, gap.select("node", "period", "gap"), dense)

    total = flat.select("node", "period", F.explode("upper").alias("a")).join(pull.withColumnRenamed("node", "a"), ["a", "period"])
    shift = total.groupBy("node", "period").agg(F.sum("x").alias("shift"))
    new = flat.join(shift, ["node", "period"], "left").withColumn("yhat", F.col("yhat") + F.col("var") * F.coalesce("shift", F.lit(0.0)))
    out = leaf.select(*keys, "node").join(new.select("node", "period", "yhat"), "node")
    return hierarchy(out.select(*keys, "period", "yhat"), levels, ("yhat",))


def solve(matrix: DataFrame, right: DataFrame, dense: int = DENSE) -> DataFrame:
    """(node, period, x) with matrix · x = gap in every period; ``matrix`` (a, b, v) is symmetric and positive.

    Up to ``dense`` nodes the driver solves it, beyond that Spark does by conjugate gradients, scaled by
    the diagonal. Per round the driver sees two numbers per period.
    """
    spark = matrix.sparkSession
    schema = f"node string, period {right.schema['period'].dataType.simpleString()}, x double"
    names = [r.node for r in right.select("node").distinct().limit(dense + 1).collect()]
    if len(names) <= dense:
        place = {n: i for i, n in enumerate(sorted(names))}
        a = np.zeros((len(place),) * 2)
        for r in matrix.collect():
            a[place[r.a], place[r.b]] = r.v
        rows = right.collect()
        when = {p: i for i, p in enumerate(sorted({r.period for r in rows}))}
        b = np.zeros((len(place), len(when)))
        for r in rows:
            b[place[r.node], when[r.period]] = r.gap
        x = np.linalg.solve(a, b) if len(place) else b
        return spark.createDataFrame([(n, p, float(x[i, j])) for n, i in place.items() for p, j in when.items()], schema)

    scale = matrix.where("a = b").select(F.col("a").alias("node"), F.col("v").alias("d"))
    now = durable(right.join(scale, "node").select("node", "period", "d", F.lit(0.0).alias("x"), F.col("gap").alias("r"), (F.col("gap") / F.col("d")).alias("p")))
    dots = lambda df, c: {r.period: r.s for r in df.groupBy("period").agg(F.sum(c).alias("s")).collect()}
    rz = dots(now, F.col("r") * F.col("r") / F.col("d"))
    first = dict(rz)

    def by_period(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("period")]

    for _ in range(ROUNDS):
        if all(rz[t] <= PRECISION**2 * first[t] for t in rz):
            break
        product = matrix.join(now.select(F.col("node").alias("b"), "period", "p"), "b").groupBy(F.col("a").alias("node"), "period").agg(F.sum(F.col("v") * F.col("p")).alias("q"))
        now = durable(now.join(product, ["node", "period"]))
        pq = dots(now, F.col("p") * F.col("q"))
        alpha = by_period({t: rz[t] / pq[t] if pq[t] else 0.0 for t in rz})
        now = durable(now.select("node", "period", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p"))
        after = dots(now, F.col("r") * F.col("r") / F.col("d"))
        beta = by_period({t: after[t] / rz[t] if rz[t] else 0.0 for t in rz})
        now = now.withColumn("p", F.col("r") / F.col("d") + beta * F.col("p"))
        rz = after
    return now.select("node", "period", "x")
