"""Preprocessing: from raw sales to a dense panel (one row per series and period)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import as_col, full_period_end, first_full_period, period_index, period_of, period_range, ratio, shift_period


def by_series(keys: list[str]):
    """The window all series features share, so that they share one shuffle and one sort."""
    return W.partitionBy(*keys).orderBy("period")


def dedupe(df: DataFrame, keys: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """Drop fully equal rows, or keep the newest row per key.

    Newest is an aggregate, not a window: each task first reduces its own rows, so a key with very many
    rows is no burden. Ties on ``newest`` go to the largest of the other columns, in column order.
    """
    if keys is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys and c != newest]
    best = df.groupBy(*keys).agg(F.max(F.struct(newest, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def enrich(df: DataFrame, dims: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Left-join attribute tables; unmatched rows keep null attributes.

    Each dim comes with ``{column of df: key column of dim}``. No broadcast is forced: Spark broadcasts
    a dim that is below its size threshold and otherwise sort-merges, with AQE splitting hot keys.
    """
    for dim, on in dims:
        cond = None
        for left, right in on.items():
            eq = df[left] == dim[right]
            cond = eq if cond is None else cond & eq
        extra = [dim[c] for c in dim.columns if c not in on.values()]
        df = df.join(dim, cond, "left").select(*[df[c] for c in df.columns], *extra)
    return df


def demand_panel(sales: DataFrame, keys: list[str], freq: str, date: str = "ds") -> DataFrame:
    """Quantity per series and period; with price also revenue, with promo also the promoted share of units.

    Money is added up in whole cents, so the sum does not depend on the order of rows.
    """
    aggs = [F.sum("qty").alias("qty")]
    if "price" in sales.columns:
        cents = F.round(F.col("qty") * F.col("price") * 100).cast("long")
        aggs.append((F.sum(cents) / F.lit(100.0)).alias("revenue"))
    if "promo" in sales.columns:
        aggs.append(ratio(F.sum(F.col("qty") * F.col("promo")), F.sum("qty")).alias("promo"))
    return sales.groupBy(*keys, period_of(date, freq).alias("period")).agg(*aggs)


def demand_panels(sales: DataFrame, keys: list[str], freqs: list[str], date: str = "ds") -> DataFrame:
    """``demand_panel`` for several frequencies, one below the other with their name in ``freq``.

    Lines are added up once, by day; longer periods are sums of days, and Spark reuses the daily shuffle.
    """
    day = F.col(date).cast("date")
    sums = {"qty": F.sum("qty")}
    if "price" in sales.columns:
        sums["_cents"] = F.sum(F.round(F.col("qty") * F.col("price") * 100).cast("long"))
    if "promo" in sales.columns:
        sums["_promoted"] = F.sum(F.col("qty") * F.col("promo"))
    daily = sales.groupBy(*keys, day.alias("_day")).agg(*[c.alias(n) for n, c in sums.items()])

    def rolled(freq: str) -> DataFrame:
        p = daily.groupBy(*keys, period_of("_day", freq).alias("period")).agg(*[F.sum(n).alias(n) for n in sums])
        made = {"revenue": F.col("_cents") / F.lit(100.0)} if "_cents" in sums else {}
        made |= {"promo": ratio("_promoted", "qty")} if "_promoted" in sums else {}
        return p.select(F.lit(freq).alias("freq"), *keys, "period", "qty", *[c.alias(n) for n, c in made.items()])

    return reduce(DataFrame.unionByName, [rolled(f) for f in freqs])


def drop_partial(panel: DataFrame, freq: str, min_ds, max_ds, period: str = "period") -> DataFrame:
    """Keep the periods that data from min_ds to max_ds covers fully.

    Works on a panel or, with ``period`` naming the raw date column, before aggregation, where the two
    comparisons reach the file scan.
    """
    return panel.where(
        (F.col(period) >= first_full_period(min_ds, freq)) & (F.col(period) < full_period_end(max_ds, freq))
    )


def _bound(panel: DataFrame, agg) -> Column:
    return panel.agg(agg("period")).scalar()


def densify(
    panel: DataFrame,
    keys: list[str],
    freq: str,
    start="series",
    end=None,
    fill: dict[str, float] | None = None,
) -> DataFrame:
    """Give every series every period, with 0 demand where it had no row.

    ``start`` is 'series' (its first row), 'global' (the first period of the panel) or a date; ``end`` is
    a date or, when left out, the last period of the panel. Columns in ``fill`` get that value in added
    rows, others null. Each row stretches over the gap up to the next row of its series, so one
    shuffle by key does it and no calendar is joined.
    """
    fill = {"qty": 0.0} if fill is None else fill
    end = _bound(panel, F.max) if end is None else as_col(end)
    panel = panel.where(F.col("period") <= end)
    if isinstance(start, str) and start == "series":
        first = F.col("period")
    else:
        first = _bound(panel, F.min) if isinstance(start, str) else as_col(start)
        panel = panel.where(F.col("period") >= first)
    w = by_series(keys)
    spans = panel.withColumns({
        "_from": F.when(F.lag("period").over(w).isNull(), first).otherwise(F.col("period")),
        "_to": F.coalesce(shift_period(F.lead("period").over(w), -1, freq), end),
    })
    grid = spans.withColumn("_p", F.explode(period_range("_from", "_to", freq)))
    seen = F.col("_p") == F.col("period")
    measures = [c for c in panel.columns if c not in keys and c != "period"]
    return grid.select(
        *keys,
        F.col("_p").alias("period"),
        *[F.when(seen, F.col(c)).otherwise(F.lit(fill.get(c))).alias(c) for c in measures],
    )


IMPUTE = ("zero", "mean", "ffill", "bfill", "linear")


def impute(panel: DataFrame, keys: list[str], col: str, how: str, out: str | None = None) -> DataFrame:
    """Fill nulls of ``col`` inside each series; what has no neighbour to copy from stays null."""
    w = by_series(keys)
    c = F.col(col)
    back = w.rowsBetween(W.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    if how == "zero":
        value = F.coalesce(c, F.lit(0.0))
    elif how == "mean":
        value = F.coalesce(c, F.avg(c).over(W.partitionBy(*keys)))
    elif how == "ffill":
        value = F.last(c, ignorenulls=True).over(back)
    elif how == "bfill":
        value = F.first(c, ignorenulls=True).over(ahead)
    elif how == "linear":
        known = F.when(c.isNotNull(), F.col("period"))
        p0, p1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        v0, v1 = F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
        value = F.coalesce(c, v0 + (v1 - v0) * F.datediff("period", p0) / F.datediff(p1, p0))
    else:
        raise ValueError(f"how must be one of {IMPUTE}, not {how!r}")
    return panel.withColumn(out or col, value)


def cap_outliers(panel: DataFrame, keys: list[str], how: str = "iqr", k: float = 1.5) -> DataFrame:
    """Clip qty per series to [Q1 − k·IQR, Q3 + k·IQR] or median ± k·MAD; ``capped`` flags changed rows.

    A series has one row per period, so its quantiles are over a bounded group.
    """
    s = W.partitionBy(*keys)
    pct = lambda c, p: F.percentile(c, F.lit(p)).over(s)
    if how == "iqr":
        q = panel.withColumns({"_q1": pct("qty", 0.25), "_q3": pct("qty", 0.75)})
        lo = F.col("_q1") - k * (F.col("_q3") - F.col("_q1"))
        hi = F.col("_q3") + k * (F.col("_q3") - F.col("_q1"))
    elif how == "mad":
        q = panel.withColumn("_med", pct("qty", 0.5))
        q = q.withColumn("_mad", pct(F.abs(F.col("qty") - F.col("_med")), 0.5))
        lo, hi = F.col("_med") - k * F.col("_mad"), F.col("_med") + k * F.col("_mad")
    else:
        raise ValueError("how must be 'iqr' or 'mad'")
    q = q.withColumns({"lo": lo, "hi": hi})
    clipped = F.least(F.greatest(F.col("qty"), F.col("lo")), F.col("hi"))
    return q.select(*panel.columns, "lo", "hi", clipped.alias("qty_capped"), (clipped != F.col("qty")).alias("capped"))


def resample(panel: DataFrame, keys: list[str], freq: str, aggs: dict[str, str]) -> DataFrame:
    """Coarser periods; ``aggs`` maps a column to 'sum', 'avg', 'min' or 'max'."""
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    return panel.groupBy(*keys, period_of("period", freq).alias("period")).agg(
        *[fns[how](c).alias(c) for c, how in aggs.items()]
    )


def hierarchy(panel: DataFrame, levels: list[list[str]], measures: tuple[str, ...] = ("qty",)) -> DataFrame:
    """Sums at every level, each level a list of keys ([] is the total).

    ``level_id`` is the grouping id: bit i from the right is set when the i-th last key is summed away.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    sets = [[*[F.col(c) for c in level], F.col("period")] for level in levels]
    names = F.concat_ws("_", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in keys])
    # period is in every set, so its (last) bit is always 0 and is shifted out of the id
    out = panel.groupingSets(sets, *keys, "period").agg(
        F.shiftright(F.grouping_id(), 1).alias("level_id"),
        F.when(names == "", F.lit("total")).otherwise(names).alias("level"),
        *[F.sum(m).alias(m) for m in measures],
    )
    return out.select("level_id", "level", *keys, "period", *measures)


def column_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, negatives (numeric columns) and distinct values, in long form."""
    cols = cols or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in cols:
        negative = F.count_if(F.col(c) < 0) if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("long")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count("*").alias("n_rows"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                negative.alias("negatives"),
                F.count_distinct(c).alias("distinct_values"),
            ).alias(c)
        )
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(f"`{c}`") for c in cols])))


def gap_report(panel: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """Per series: first and last period, rows, and periods missing in between."""
    i = period_index("period", freq)
    return panel.groupBy(*keys).agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count("*").alias("n_rows"),
        (F.max(i) - F.min(i) + 1 - F.count("*")).cast("long").alias("gaps"),
    )


def time_split(panel: DataFrame, cut1, cut2) -> DataFrame:
    """Label rows train (before cut1), valid (before cut2) or test."""
    p = F.col("period")
    return panel.withColumn(
        "split", F.when(p < as_col(cut1), "train").when(p < as_col(cut2), "valid").otherwise("test")
    )
