"""Features of a series at period t from rows before t.

Only calendar values, the planned promotion and externals known by t may look at t itself. All series
features use one window per key set, so Spark computes them after one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.columns import as_col, period_index, period_range, ratio, shift_period
from ..functions.rows import CELLS
from ..functions.runtime import durable
from .panel import by_series


def calendar(df: DataFrame, freq: str = "month") -> DataFrame:
    """Year, quarter, month, ISO week, ISO weekday (1 = Monday), month start and end flags."""
    p = F.col("period")
    last_day = F.date_add(shift_period(p, 1, freq), -1)
    return df.withColumns({
        "year": F.year(p),
        "quarter": F.quarter(p),
        "month": F.month(p),
        "iso_week": F.weekofyear(p),
        "iso_weekday": F.weekday(p) + 1,
        "is_month_start": F.dayofmonth(p) == 1,
        "is_month_end": last_day == F.last_day(last_day),
    })


def lag_cols(keys: list[str], ks: list[int], col: str = "qty") -> dict[str, Column]:
    w = by_series(keys)
    return {f"lag_{k}": F.lag(col, k).over(w) for k in ks}


def lags(panel: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    return panel.withColumns(lag_cols(keys, ks))


def rolling_cols(keys: list[str], ns: list[int], col: str = "qty") -> dict[str, Column]:
    out = {}
    for n in ns:
        w = by_series(keys).rowsBetween(-n, -1)
        out |= {
            f"mean_{n}": F.avg(col).over(w),
            f"sd_{n}": F.stddev_samp(col).over(w),
            f"min_{n}": F.min(col).over(w),
            f"max_{n}": F.max(col).over(w),
            f"zero_share_{n}": F.avg((F.col(col) == 0).cast("double")).over(w),
        }
    return out


def rolling(panel: DataFrame, keys: list[str], ns: list[int]) -> DataFrame:
    """Mean, sd, min, max and share of zeros over the n rows before t."""
    return panel.withColumns(rolling_cols(keys, ns))


def expanding(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and number of all earlier rows."""
    w = by_series(keys).rowsBetween(W.unboundedPreceding, -1)
    return panel.withColumns({"mean_all": F.avg("qty").over(w), "n_all": F.count("qty").over(w)})


def ewma_col(keys: list[str], alpha: float, n: int, col: str = "qty") -> Column:
    w = by_series(keys)
    past = [(alpha * (1 - alpha) ** i, F.lag(col, i + 1).over(w)) for i in range(n)]
    num = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) * wt for wt, x in past])
    den = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), wt).otherwise(0.0) for wt, x in past])
    return ratio(num, den)


def ewma(panel: DataFrame, keys: list[str], alpha: float, n: int) -> DataFrame:
    """Mean of the last n rows with weights α(1−α)^i, normalised over the rows that exist."""
    return panel.withColumn("ewma", ewma_col(keys, alpha, n))


def diffs(panel: DataFrame, keys: list[str], season: int) -> DataFrame:
    """Last change, last percent change, and last value against one season earlier."""
    w = by_series(keys)
    l1, l2, ls = (F.lag("qty", k).over(w) for k in (1, 2, 1 + season))
    return panel.withColumns({"diff_1": l1 - l2, "pct_1": ratio(l1 - l2, l2), "diff_season": l1 - ls})


def fourier(panel: DataFrame, freq: str, m: int, K: int) -> DataFrame:
    """sin and cos of 2πjt/m for j = 1…K, t the period index."""
    t = period_index("period", freq)
    # the angle of a whole number of turns is dropped first, which keeps the arguments small
    angle = lambda j: F.pmod(t * j, F.lit(m)) * (2 * math.pi / m)
    cols = {}
    for j in range(1, K + 1):
        cols |= {f"sin_{j}": F.sin(angle(j)), f"cos_{j}": F.cos(angle(j))}
    return panel.withColumns(cols)


def promo(panel: DataFrame, keys: list[str], freq: str, ks: tuple[int, ...] = (1, 2), at_least: float = 0.5) -> DataFrame:
    """Promoted share at t (planned), its lags, and periods since the last earlier promo period."""
    w = by_series(keys)
    t = period_index("period", freq)
    was = F.last(F.when(F.col("promo") >= at_least, t), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return panel.withColumns({
        **{f"promo_lag_{k}": F.lag("promo", k).over(w) for k in ks},
        "since_promo": t - was,
    })


def event_distance(panel: DataFrame, events: DataFrame, on: list[str] = [], date: str = "ds") -> DataFrame:
    """Days since the last event (≤ t) and to the next one (≥ t) of a calendar known ahead.

    Worked out once per distinct date (and ``on`` value), not per series: the window then holds at most
    the days of the calendar, whatever the number of series.
    """
    days = panel.select(*on, F.col("period").alias("_d")).distinct().withColumn("_event", F.lit(False))
    marks = events.select(*on, F.col(date).alias("_d")).distinct().withColumn("_event", F.lit(True))
    w = W.partitionBy(*on).orderBy("_d").rangeBetween
    mark = F.when(F.col("_event"), F.col("_d"))
    last = F.max(mark).over(w(W.unboundedPreceding, 0))
    following = F.min(mark).over(w(0, W.unboundedFollowing))
    dist = (
        days.unionByName(marks)
        .withColumns({
            "since_event": F.datediff(F.col("_d"), last),
            "to_event": F.datediff(following, F.col("_d")),
        })
        .where(~F.col("_event"))
        .select(*[F.col(c).alias(f"_{c}") for c in on], "_d", "since_event", "to_event")
    )
    cond = panel["period"] == dist["_d"]
    for c in on:
        cond = cond & panel[c].eqNullSafe(dist[f"_{c}"])
    return panel.join(dist, cond, "left").select(*panel.columns, "since_event", "to_event")


def asof(
    panel: DataFrame, ext: DataFrame, on: list[str], cols: list[str], date: str = "ds", known_by_t: bool = False
) -> DataFrame:
    """Newest external row per ``on`` with date < t, or ≤ t when it is known by then.

    Both sides are first cut to one row per (``on``, date): the window is bounded by the calendar even
    when one ``on`` value holds a third of the panel. Of a day's rows the newest counts, of equally new
    ones that with the larger ``cols``. The tag sorts external rows before panel rows for ≤ and after them for <.
    """
    want = panel.select(*on, F.col("period").alias("_d")).distinct()
    newest = F.max(F.struct(F.col(date).alias("_at"), *cols)).alias("_x")
    have = ext.groupBy(*on, F.col(date).cast("date").alias("_d")).agg(newest)
    tag = 0 if known_by_t else 2
    both = want.withColumns({"_tag": F.lit(1), "_x": F.lit(None).cast(have.schema["_x"].dataType)}).unionByName(
        have.withColumn("_tag", F.lit(tag))
    )
    w = W.partitionBy(*on).orderBy("_d", "_tag").rowsBetween(W.unboundedPreceding, 0)
    found = (
        both.withColumn("_x", F.last("_x", ignorenulls=True).over(w))
        .where(F.col("_tag") == 1)
        .select(*[F.col(c).alias(f"_{c}") for c in on], "_d", *[F.col(f"_x.{c}").alias(c) for c in cols])
    )
    cond = panel["period"] == found["_d"]
    for c in on:
        cond = cond & panel[c].eqNullSafe(found[f"_{c}"])
    return panel.join(found, cond, "left").select(*panel.columns, *cols)


def recency(panel: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """Periods since the last nonzero demand before t, and its size."""
    w = by_series(keys).rowsBetween(W.unboundedPreceding, -1)
    sold = F.col("qty") > 0
    t = period_index("period", freq)
    return panel.withColumns({
        "since_sale": t - F.last(F.when(sold, t), ignorenulls=True).over(w),
        "last_size": F.last(F.when(sold, F.col("qty")), ignorenulls=True).over(w),
    })


def target_encode(panel: DataFrame, cat: str, s: float) -> DataFrame:
    """(Σy + s·global mean)/(n + s) per category over earlier periods; null where there are none.

    Sums per category and period are made first, so the running windows hold one row per period.
    """
    per_cat = panel.groupBy(cat, "period").agg(F.sum("qty").alias("_y"), F.count("qty").alias("_n"))
    total = per_cat.groupBy("period").agg(F.sum("_y").alias("_ty"), F.sum("_n").alias("_tn"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    wt = before(W.orderBy("period"))  # one row per period: bounded by the calendar
    total = total.select(F.col("period").alias("_p"), ratio(F.sum("_ty").over(wt), F.sum("_tn").over(wt)).alias("_g"))
    wc = before(W.partitionBy(cat).orderBy("period"))
    enc = per_cat.select(
        F.col(cat).alias("_c"),
        "period",
        F.coalesce(F.sum("_y").over(wc), F.lit(0.0)).alias("_y"),
        F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_n"),
    )
    enc = enc.join(total, enc.period == total._p).select(
        "_c", "_p", ((F.col("_y") + s * F.col("_g")) / (F.col("_n") + s)).alias(f"{cat}_enc")
    )
    cond = panel[cat].eqNullSafe(enc["_c"]) & (panel["period"] == enc["_p"])
    return panel.join(enc, cond, "left").select(*panel.columns, f"{cat}_enc")


def encode(train: DataFrame, cols: list[str]):
    """Fitted pipeline: ``c_idx`` (0 = most frequent) and one-hot ``c_vec`` per column.

    A value not seen in ``train`` gets the last index and its own slot.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = StringIndexer(
        inputCols=cols, outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep",
        stringOrderType="frequencyDesc",
    )
    # the indexer already keeps a last index for unseen values, so the encoder needs no slot of its own
    onehot = OneHotEncoder(
        inputCols=index.getOutputCols(), outputCols=[f"{c}_vec" for c in cols], dropLast=False, handleInvalid="error"
    )
    return Pipeline(stages=[index, onehot]).fit(train)


def scale(panel: DataFrame, keys: list[str], how: str, train_before) -> DataFrame:
    """``scaled`` qty: 'standard' with each series' train mean and sd (kept beside it), or 'log1p'.

    Undo with ``unscale``. A constant series scales to 0.
    """
    if how == "log1p":
        return panel.withColumn("scaled", F.log1p("qty"))
    if how != "standard":
        raise ValueError("how must be 'standard' or 'log1p'")
    s = W.partitionBy(*keys)
    y = F.when(F.col("period") < as_col(train_before), F.col("qty"))
    out = panel.withColumns({"scale_mean": F.avg(y).over(s), "scale_sd": F.stddev_pop(y).over(s)})
    z = F.when(F.col("scale_sd") > 0, (F.col("qty") - F.col("scale_mean")) / F.col("scale_sd"))
    return out.withColumn("scaled", F.when(F.col("scale_sd").isNotNull(), F.coalesce(z, F.lit(0.0))))


def unscale(df: DataFrame, how: str, col: str = "scaled", out: str = "qty") -> DataFrame:
    if how == "log1p":
        return df.withColumn(out, F.expm1(col))
    return df.withColumn(out, F.col(col) * F.col("scale_sd") + F.col("scale_mean"))


def event_types(events: DataFrame, ts: str, kind: str, days: int = 7) -> DataFrame:
    """Per day and type of event: how many there were, the day before, and over the ``days`` before.

    Every type has a row for every day between the first and the last event of any. Events are counted
    before the shuffle; from then on there is a row per type and day.
    """
    daily = events.groupBy(F.col(kind), F.col(ts).cast("date").alias("period")).agg(F.count("*").alias("n"))
    span = daily.agg(F.sequence(F.min("period"), F.max("period"))).scalar()
    grid = daily.select(kind).distinct().withColumn("period", F.explode(span))
    filled = grid.join(daily, [kind, "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(kind).orderBy("period")
    return filled.select(
        "period", kind, "n", F.lag("n").over(w).alias("lag_1"), F.sum("n").over(w.rowsBetween(-days, -1)).alias(f"last_{days}")
    )


def supervised(
    panel: DataFrame,
    keys: list[str],
    freq: str,
    h: int = 1,
    ks: tuple[int, ...] = (1, 2, 3, 12),
    ns: tuple[int, ...] = (3, 12),
) -> DataFrame:
    """One row per series and target period with features known at ``origin`` and label qty.

    ``origin`` is the last period whose demand is known, ``period`` = origin + h the one to forecast.
    """
    w = by_series(keys)
    t = period_index("period", freq)
    sold = F.last(F.when(F.col("qty") > 0, t), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    target = F.lead("period", h - 1).over(w)
    out = panel.select(
        *keys,
        F.lag("period").over(w).alias("origin"),
        target.alias("period"),
        F.lit(h).alias("h"),
        *[c.alias(n) for n, c in lag_cols(keys, list(ks)).items()],
        *[c.alias(n) for n, c in rolling_cols(keys, list(ns)).items()],
        (t - sold).alias("since_sale"),
        F.month(target).alias("month"),
        F.lead("qty", h - 1).over(w).alias("label"),
    )
    return out.where(F.col("origin").isNotNull() & F.col("period").isNotNull())


@dataclass(frozen=True)
class SeriesRows:
    """The rows of ``supervised`` on the panel that ``densify`` makes between two periods, held as one record per series.

    A record holds the keys, a hash of them, and the packed values of all periods. Rows are worked out from it in
    batches where they are needed, by ``frame`` or ``matrices``; they need not be stored. ``first`` and ``end`` bound them.
    """

    series: DataFrame
    keys: list[str]
    schema: StructType
    periods: np.ndarray
    h: int
    ks: tuple[int, ...]
    ns: tuple[int, ...]
    first: int
    end: int

    def before(self, cut) -> SeriesRows:
        """The rows whose period lies before ``cut``."""
        return replace(self, end=min(self.end, self._at(cut)))

    def since(self, cut) -> SeriesRows:
        return replace(self, first=max(self.first, self._at(cut)))

    def _at(self, cut) -> int:
        return int(np.searchsorted(self.periods[self.h :], np.datetime64(cut, "D")))

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, dict[str, tuple[np.ndarray, np.ndarray]]]]:
        """Stretches of a batch of series: how many series, their records, and the features with what is known of them."""
        length = len(self.periods)
        some = max(1, CELLS // (128 * length))  # a stretch stays in the processor's cache
        for a in range(0, batch.num_rows if self.end > self.first else 0, some):
            part = batch.slice(a, some)
            flat = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, length)
            yield part.num_rows, part, self._features(flat("_y", np.float64), flat("_known", np.bool_))

    def _features(self, y: np.ndarray, known: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Sums run from the oldest value on, as they do in a window."""
        rows, pad = self.end - self.first, max(*self.ks, *self.ns)
        wide = lambda a: np.pad(a, ((0, 0), (pad, 0)))
        back = lambda a, k: a[:, pad + 1 - k + self.first : pad + 1 - k + self.end]
        v, has = wide(y), wide(known)
        out = {f"lag_{k}": (back(v, k), back(has, k)) for k in self.ks}
        for n in self.ns:
            total, zeros, count, mean, m2 = (np.zeros((len(y), rows)) for _ in range(5))
            least, most = (np.full((len(y), rows), np.nan) for _ in range(2))
            for k in range(n, 0, -1):
                x, on = back(v, k), back(has, k)
                start = on & (count == 0)
                total = np.where(on, total + x, total)
                zeros += on & (x == 0)
                count += on
                delta = x - mean
                step = delta / np.maximum(count, 1)
                mean, m2 = np.where(on, mean + step, mean), np.where(on, m2 + delta * (delta - step), m2)
                # NaN is the largest number
                least = np.where(start, x, np.where(on, np.fmin(least, x), least))
                most = np.where(start, x, np.where(on, np.maximum(most, x), most))
            any_, two = count > 0, count > 1
            out[f"mean_{n}"] = total / np.maximum(count, 1), any_
            out[f"sd_{n}"] = np.sqrt(m2 / np.maximum(count - 1, 1)), two
            out[f"min_{n}"], out[f"max_{n}"] = (least, any_), (most, any_)
            out[f"zero_share_{n}"] = zeros / np.maximum(count, 1), any_
        t = np.arange(len(self.periods))
        sold = np.maximum.accumulate(np.where(known & ((y > 0) | np.isnan(y)), t, -1), axis=1)[:, self.first : self.end]
        out["since_sale"] = t[self.first + 1 : self.end + 1] - sold, sold >= 0
        target = slice(self.first + self.h, self.end + self.h)
        out["label"] = y[:, target], known[:, target]
        month = self.periods[target].astype("datetime64[M]").astype(int) % 12 + 1
        out["month"] = np.tile(month, (len(y), 1)), np.ones((len(y), rows), bool)
        return out

    def matrices(self, batch: pa.RecordBatch, cols: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(columns × rows with NaN for what is missing, labels, a hash) of the rows with a label, by stretches of series."""
        for _, part, made in self.parts(batch):
            y, known = (a.ravel() for a in made["label"])
            x = np.stack([np.where(made[c][1], made[c][0], np.nan).ravel()[known] for c in cols])
            lot = part.column("_id").to_numpy().astype(np.uint64)[:, None] + np.arange(self.first, self.end, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            lot = (lot ^ (lot >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            lot = (lot ^ (lot >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield x, y[known], (lot ^ (lot >> np.uint64(31))).ravel()[known]

    def frame(self) -> DataFrame:
        """The rows as ``supervised`` returns them."""
        from pyspark.sql.pandas.types import to_arrow_schema

        types, rows = to_arrow_schema(self.schema), self.plain()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = rows.end - rows.first
            same = {
                "origin": rows.periods[rows.first : rows.end], "period": rows.periods[rows.first + rows.h : rows.end + rows.h],
                "h": np.full(many, rows.h),
            }
            for batch in batches:
                for n, part, made in rows.parts(batch):
                    series_of, columns = pa.array(np.repeat(np.arange(n), many)), []
                    for f in types:
                        if f.name in rows.keys:
                            columns.append(part.column(f.name).take(series_of))
                        elif f.name in same:
                            columns.append(pa.array(np.tile(same[f.name], n)).cast(f.type))
                        else:
                            x, known = made[f.name]
                            columns.append(pa.array(x.ravel(), f.type, mask=~known.ravel()))
                    yield pa.RecordBatch.from_arrays(columns, types.names)

        return self.series.mapInArrow(run, self.schema)

    def plain(self) -> SeriesRows:
        """Without the frame, to go to the tasks."""
        return replace(self, series=None)


def supervised_series(
    panel: DataFrame,
    keys: list[str],
    freq: str,
    span: tuple,
    h: int = 1,
    ks: tuple[int, ...] = (1, 2, 3, 12),
    ns: tuple[int, ...] = (3, 12),
) -> SeriesRows:
    """``supervised`` without its rows: for a sparse panel, every series of which gets 0 where it has no row between
    the first and the last period (``span``). One record per series is stored."""
    from pyspark.sql.pandas.types import to_arrow_schema

    lo, hi = map(as_col, span)
    made = panel.select(*keys, "period", F.col("qty").cast("double").alias("qty"))
    schema = supervised(made, keys, freq, h, ks, ns).schema
    start, days = panel.sparkSession.range(1).select(period_index(lo, freq), period_range(lo, hi, freq)).first()
    length = len(days)
    made = made.where((F.col("period") >= lo) & (F.col("period") <= hi))
    cells = F.collect_list(F.struct((period_index("period", freq) - start).alias("t"), F.col("qty").alias("y")))
    series = made.groupBy(*keys).agg(cells.alias("_cells")).select(*keys, F.xxhash64(*keys).alias("_id"), "_cells")
    stored = StructType([*series.schema[:-1], StructField("_y", BinaryType()), StructField("_known", BinaryType())])
    names = to_arrow_schema(stored).names

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = batch.num_rows, batch.column(len(keys) + 1)
            flat = held.flatten()
            at = np.repeat(np.arange(n), held.value_lengths().to_numpy(zero_copy_only=False)) * length + flat.field("t").to_numpy()
            if len(np.unique(at)) < len(at):
                raise ValueError("a series has two rows in one period")
            value = flat.field("y")
            y, known = np.zeros(n * length), np.ones(n * length, bool)
            y[at], known[at] = value.fill_null(0.0).to_numpy(zero_copy_only=False), value.is_valid().to_numpy(zero_copy_only=False)
            packed = [pa.array([r.tobytes() for r in a.reshape(n, length)], pa.binary()) for a in (y, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *packed], names)

    return SeriesRows(
        durable(series.mapInArrow(pack, stored)), keys, schema, np.array(days, dtype="datetime64[D]"), h, ks, ns, 0, max(0, length - h)
    )


def feature_names(ks: tuple[int, ...] = (1, 2, 3, 12), ns: tuple[int, ...] = (3, 12)) -> list[str]:
    """Names of the feature columns that ``supervised`` makes."""
    return [f"lag_{k}" for k in ks] + [
        f"{s}_{n}" for n in ns for s in ("mean", "sd", "min", "max", "zero_share")
    ] + ["since_sale", "month"]


def rank_features(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Features by absolute correlation with the label; a constant feature has none and goes last."""
    x = lambda c: F.col(c).cast("double")
    pair = lambda c: x(c).isNotNull() & F.col(label).isNotNull()
    aggs = []
    for c in cols:
        both = pair(c)
        a, b = F.when(both, x(c)), F.when(both, F.col(label))
        spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
        aggs.append(F.when(spread > 0, F.covar_pop(a, b) / spread).alias(c))
    long = df.agg(*aggs).unpivot([], cols, "feature", "corr")
    w = W.orderBy(F.round(F.abs("corr"), 9).desc_nulls_last(), "feature")  # one row per feature
    return long.withColumn("rank", F.row_number().over(w))
