import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as X, panel as P
from shelfcast.sources.panel_store import read_panel, write_panel
from shelfcast.sources.sales import read_sales, read_sales_csv
from tests.conftest import month


def values(df, col="qty", series="a"):
    return [r[col] for r in df.where(F.col("s") == series).orderBy("period").collect()]


def test_read_sales_fails_on_a_missing_column(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(3).select(F.col("id").alias("q")).write.parquet(path)
    with pytest.raises(ValueError, match="not in"):
        read_sales(spark, path, {"qty": "units"}, "q bigint, units double")
    with pytest.raises(ValueError, match="declared"):
        read_sales(spark, path, {"qty": "other"}, "q bigint")
    assert read_sales(spark, path, {"qty": "q"}, "q bigint").dtypes == [("qty", "double")]


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "x.csv").write_text("day,item,units\n2020-01-01,7,2.5\n2020-01-02,8,many\nnonsense\n\n")
    good, bad = read_sales_csv(
        spark, str(tmp_path), "day date, item bigint, units double", {"ds": "day", "item": "item", "qty": "units"}
    )
    assert [tuple(r) for r in good.collect()] == [(dt.date(2020, 1, 1), 7, 2.5)]
    assert sorted(r.line for r in bad.collect()) == ["2020-01-02,8,many", "nonsense"]


def test_csv_columns_go_by_the_header(spark, tmp_path):
    ddl, names = "day date, item bigint, units double", {"ds": "day", "item": "item", "qty": "units"}
    for i, text in enumerate(["day,units,item\n2020-01-01,2.5,7\n", '"units" ,"extra","day","item"\n2.5,"a, b",2020-01-01,7\n']):
        folder = tmp_path / f"f{i}"
        folder.mkdir()
        for part in "ab":
            (folder / f"{part}.csv").write_text(text)
        good, bad = read_sales_csv(spark, str(folder), ddl, names)
        assert [tuple(r) for r in good.collect()] == [(dt.date(2020, 1, 1), 7, 2.5)] * 2
        assert bad.count() == 0
    (tmp_path / "missing.csv").write_text("day,units\n2020-01-01,2.5\n")
    with pytest.raises(ValueError, match="item"):
        read_sales_csv(spark, str(tmp_path / "missing.csv"), ddl, names)
    (tmp_path / "plain.csv").write_text("2020-01-01,7,2.5\n")
    good, bad = read_sales_csv(spark, str(tmp_path / "plain.csv"), ddl, names, header=False)
    assert good.count() == 1 and bad.count() == 0


def test_panels_of_several_frequencies_are_those_of_each(spark):
    rows = [("a", dt.date(2020, 1, d), float(d), 1.5, float(d % 2)) for d in range(1, 29)] + [("b", dt.date(2020, 2, 3), 5.0, 2.0, 0.0)] * 3
    s = spark.createDataFrame(rows, "s string, ds date, qty double, price double, promo double")
    many = P.demand_panels(s, ["s"], ["day", "week", "month"])
    for freq in ("day", "week", "month"):
        one = P.demand_panel(s, ["s"], freq)
        assert sorted(map(tuple, many.where(F.col("freq") == freq).drop("freq").collect())) == sorted(map(tuple, one.collect()))


def test_write_panel_replaces_touched_partitions_only(spark, make_panel, tmp_path):
    path = str(tmp_path / "p")
    p = make_panel({"a": range(24)})
    write_panel(p, path)
    write_panel(p.where(F.year("period") == 2021).withColumn("qty", -F.col("qty")), path)
    back = read_panel(spark, path, "s string, period date, qty double, bucket int")
    assert values(back) == [*range(12), *[-i for i in range(12, 24)]]


def test_panel_total_is_raw_total_and_densify_adds_only_zeros(spark):
    rows = [("a", dt.date(2020, 1, 5), 2.0), ("a", dt.date(2020, 1, 9), 1.0), ("a", dt.date(2020, 3, 1), 4.0), ("b", dt.date(2020, 2, 2), 5.0)]
    s = spark.createDataFrame(rows, "s string, ds date, qty double")
    panel = P.demand_panel(s, ["s"], "month")
    own = P.densify(panel, ["s"], "month")
    assert values(own) == [3.0, 0.0, 4.0] and values(own, series="b") == [5.0, 0.0]
    whole = P.densify(panel, ["s"], "month", start="global")
    assert values(whole, series="b") == [0.0, 5.0, 0.0]
    dated = P.densify(panel, ["s"], "month", start=dt.date(2019, 12, 1), end=dt.date(2020, 4, 1))
    assert values(dated, series="b") == [0.0, 0.0, 5.0, 0.0, 0.0]
    assert whole.agg(F.sum("qty")).first()[0] == 12.0
    empty = P.densify(panel.limit(0), ["s"], "month")
    assert empty.collect() == [] and empty.columns == ["s", "period", "qty"]


def test_demand_panel_week_starts_on_monday(spark):
    s = spark.createDataFrame([("a", dt.date(1995, 1, 1), 1.0)], "s string, ds date, qty double")
    assert P.demand_panel(s, ["s"], "week").first().period == dt.date(1994, 12, 26)


def test_enrich_keeps_unmatched(spark):
    f = spark.createDataFrame([(1, 2.0), (9, 3.0)], "k int, q double")
    d = spark.createDataFrame([(1, "x")], "id int, name string")
    assert {r.k: r.name for r in P.enrich(f, [(d, {"k": "id"})]).collect()} == {1: "x", 9: None}


def test_impute(spark):
    vals = [10.0, None, 8.0, None, 11.0]
    p = spark.createDataFrame([("a", dt.date(2020, 1, 1 + i), v) for i, v in enumerate(vals)], "s string, period date, qty double")
    got = {how: values(P.impute(p, ["s"], "qty", how)) for how in P.IMPUTE}
    assert got["ffill"] == [10, 10, 8, 8, 11]
    assert got["bfill"] == [10, 8, 8, 11, 11]
    assert got["zero"] == [10, 0, 8, 0, 11]
    assert got["linear"] == [10, 9, 8, 9.5, 11]
    assert got["mean"][1] == pytest.approx(29 / 3)


def test_cap_outliers_flags_changes(make_panel):
    p = make_panel({"a": [1, 2, 3, 4, 100]})
    assert values(P.cap_outliers(p, ["s"]), "qty_capped") == [1, 2, 3, 4, 7]
    assert values(P.cap_outliers(p, ["s"], "mad", 2.0), "capped") == [False, False, False, False, True]


def test_time_split_is_a_partition(make_panel):
    p = P.time_split(make_panel({"a": range(6)}), month(2), month(4))
    assert values(p, "split") == ["train", "train", "valid", "valid", "test", "test"]


def test_features_do_not_see_the_future(spark, make_panel):
    base = [3, 0, 5, 2, 0, 0, 7, 1, 4, 0, 2, 6, 3, 5, 1, 8]
    cut = 10
    changed = base[:cut] + [99 + i for i in range(len(base) - cut)]

    def features(v):
        p = make_panel({"a": v, "b": v[::-1] if v is base else base[::-1]})
        p = X.ewma(X.diffs(X.expanding(X.rolling(X.lags(p, ["s"], [1, 2]), ["s"], [3]), ["s"]), ["s"], 4), ["s"], 0.3, 4)
        p = X.recency(p, ["s"], "month")
        return [tuple(r)[3:] for r in p.where(F.col("s") == "a").orderBy("period").limit(cut + 1).collect()]

    assert features(base) == features(changed)


def test_target_encoding_uses_earlier_periods_only(spark):
    rows = [("x", "a", month(0), 2.0), ("x", "b", month(0), 4.0), ("y", "c", month(0), 6.0), ("x", "a", month(1), 100.0), ("y", "c", month(1), 1.0)]
    p = spark.createDataFrame(rows, "cat string, s string, period date, qty double")
    got = {(r.s, r.period): r.cat_enc for r in X.target_encode(p, "cat", 1.0).collect()}
    assert got["a", month(0)] is None
    assert got["a", month(1)] == pytest.approx((6 + 4) / 3)
    assert got["c", month(1)] == pytest.approx((6 + 4) / 2)


def test_asof_before_and_known(spark, make_panel):
    p = make_panel({"a": [1, 1, 1]})
    ext = spark.createDataFrame([("a", month(1), 7), ("a", dt.date(2019, 5, 1), 3)], "s string, ds date, v int")
    assert values(X.asof(p, ext, ["s"], ["v"]), "v") == [3, 3, 7]
    assert values(X.asof(p, ext, ["s"], ["v"], known_by_t=True), "v") == [3, 7, 7]


def test_unseen_category_has_its_own_slot(spark):
    train = spark.createDataFrame([("u",), ("u",), ("v",)], "c string")
    out = X.encode(train, ["c"]).transform(spark.createDataFrame([("u",), ("v",), ("new",)], "c string")).collect()
    assert [r.c_idx for r in out] == [0.0, 1.0, 2.0]
    assert [r.c_vec.toArray().tolist() for r in out] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_scale_round_trip(make_panel):
    p = make_panel({"a": [1, 5, 2, 8], "flat": [4, 4, 4, 4]})
    z = X.scale(p, ["s"], "standard", month(3))
    assert values(z, "scaled", "flat") == [0, 0, 0, 0]
    assert values(X.unscale(z.drop("qty"), "standard")) == pytest.approx([1, 5, 2, 8])


def test_constant_feature_ranks_last(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(-i)) for i in range(5)], "a double, c double, label double")
    assert [(r.feature, r.rank) for r in X.rank_features(df, ["c", "a"], "label").orderBy("rank").collect()] == [("a", 1), ("c", 2)]
