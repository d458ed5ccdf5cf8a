"""Trees over packed rows, and rows worked out of one record per series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import boost as B, features as X, learn as L, panel as P
from tests.conftest import month

COLS = X.feature_names()


@pytest.fixture(scope="module")
def sparse(spark):
    """Series with gaps, with unknown demand, with a missing key, with one sale, and without any."""
    rows = [(None if s == 7 else f"s{s}", month(i), None if (s + i) % 11 == 0 else float((s * i * 7 + i * i) % 23) + s / 8)
            for s in range(60) for i in range(30) if (s * 5 + i * i) % 3 or s % 4 == 0]
    rows += [("one", month(13), 4.0), ("zero", month(2), 0.0), ("out", month(40), 9.0)]
    return spark.createDataFrame(rows, "s string, period date, qty double")


@pytest.fixture(scope="module")
def dense(sparse):
    return P.densify(sparse, ["s"], "month", start=month(0), end=month(29))


@pytest.fixture(scope="module")
def rows(sparse):
    return X.supervised_series(sparse, ["s"], "month", (month(0), month(29)))


@pytest.mark.parametrize("h", [1, 3])
def test_rows_of_series_are_those_of_the_dense_panel(sparse, dense, h):
    want = X.supervised(dense, ["s"], "month", h=h)
    series = X.supervised_series(sparse, ["s"], "month", (month(0), month(29)), h=h)
    got = series.frame()
    assert got.dtypes == want.dtypes
    assert got.count() == want.count() == 62 * (30 - h)
    assert got.exceptAll(want).count() == 0
    late = want.where(F.col("period") >= F.lit(month(25)))
    assert late.exceptAll(series.since(month(25)).frame()).count() == 0
    assert series.since(month(25)).frame().count() + series.before(month(25)).frame().count() == want.count()


def test_weeks_and_days(spark):
    import datetime as dt

    days = [("a", dt.date(2020, 1, 6) + dt.timedelta(days=i), float(i)) for i in (0, 7, 21, 28)] + [("b", dt.date(2020, 1, 13), 2.0)]
    p = spark.createDataFrame(days, "s string, period date, qty double")
    for freq, last in (("week", dt.date(2020, 2, 3)), ("day", dt.date(2020, 2, 5))):
        first = dt.date(2020, 1, 6)
        want = X.supervised(P.densify(p, ["s"], freq, start=first, end=last), ["s"], freq, ks=(1, 2), ns=(3,))
        got = X.supervised_series(p, ["s"], freq, (first, last), ks=(1, 2), ns=(3,)).frame()
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_period_that_comes_twice_is_refused(sparse):
    with pytest.raises(Exception, match="two rows in one period"):
        X.supervised_series(sparse.unionByName(sparse), ["s"], "month", (month(0), month(29)))


def test_packed_trees_are_those_of_spark_ml(dense, rows):
    """On no more rows than cut points are fitted on, where no sample is drawn."""
    cut, cols = month(26), [c for c in COLS if c != "min_12"]
    sup = X.supervised(dense, ["s"], "month")
    plain = L.fit_gbt(sup.where(F.col("period") < F.lit(cut)), ["s"], cols, trees=6, depth=3)
    packed = L.fit_gbt(rows.before(cut), ["s"], cols, trees=6, depth=3)
    assert L.feature_names(packed) == L.feature_names(plain)
    late = sup.where(F.col("period") >= F.lit(cut))
    want = {(r.s, r.period): r.yhat for r in L.predict(plain, late, ["s"], "gbt").collect()}
    got = {(r.s, r.period): r.yhat for r in L.predict(packed, rows.since(cut).frame(), ["s"], "gbt").collect()}
    assert len(got) == 62 * 4 and got == pytest.approx(want, abs=1e-9)
    top = [r.feature for r in L.importance(packed, dense.sparkSession).orderBy("rank").collect()]
    assert top[0] == L.importance(plain, dense.sparkSession).orderBy("rank").first().feature


def test_more_rows_than_the_sample_do_not_depend_on_their_layout(spark):
    """Trees used to change with the number of partitions, as their sample of rows did."""
    h = F.pmod(F.xxhash64("id", "m"), F.lit(40))
    p = spark.range(700).crossJoin(spark.range(30).select(F.col("id").alias("m"))).where(h > 9)
    p = p.select("id", F.add_months(F.lit(month(0)), F.col("m").cast("int")).alias("period"), (h % 17 + F.col("id") % 5 * 3).cast("double").alias("qty"))
    told = []
    for n in (1, 6):
        rows = X.supervised_series(p.repartition(n, F.rand(n)), ["id"], "month", (month(0), month(29)))
        model = L.fit_gbt(rows.before(month(27)), ["id"], COLS, trees=3)
        assert sum(leaf.rows for leaf in B._leaves(model.roots[-1])) == 700 * 26  # all rows, not those of the sample
        told.append({(r.id, r.period): r.yhat for r in L.predict(model, rows.since(month(27)).frame(), ["id"], "gbt").collect()})
    assert len(told[0]) == 2100 and told[0] == pytest.approx(told[1], abs=1e-9)


def test_cut_points():
    assert B.cut_points(np.array([3.0, 1.0, 1.0, 0.0]), 5).tolist() == [0.5, 2.0]
    assert B.cut_points(np.array([2.0, 2.0]), 5).tolist() == []
    assert B.cut_points(np.repeat(np.arange(8.0), 10), 3).tolist() == [1.5, 3.5, 5.5]


def test_codes_hold_every_bin():
    rng = np.random.default_rng(1)
    cuts = [np.sort(rng.random(k)) for k in (31, 0, 1, 12, 31, 3, 1, 30)]
    x = rng.random((8, 500))
    how = B.Codes.of(cuts)
    packed = how.pack(x)
    assert len(packed) < 8 and packed.max() < B.LIMIT
    for f, c in enumerate(cuts):
        assert (how.bin_of(f)[packed[how.group[f]]] == np.searchsorted(c, x[f])).all()


def test_no_label_is_an_error(sparse, rows):
    with pytest.raises(ValueError, match="no row has a label"):
        L.fit_gbt(rows.before(month(0)), ["s"], COLS)
