import math

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.runtime import TooLarge
from shelfcast.operators import patterns as T, rules as R
from tests.conftest import month

CASES = {
    "all_zero": [0] * 12, "single": [0] * 5 + [5] + [0] * 6, "constant": [4] * 12, "every_third": [3, 0, 0] * 4,
    "lumpy": [1, 0, 0, 20] * 3, "erratic": [1, 20] * 6,
}


def test_hand_sized_classes(make_panel):
    got = {r.s: r for r in R.classify_sbc(T.adi_cv2(make_panel(CASES), ["s"])).collect()}
    want = {
        "all_zero": "no_demand", "single": "intermittent", "constant": "smooth", "every_third": "intermittent",
        "lumpy": "lumpy", "erratic": "erratic",
    }
    assert {s: r.segment for s, r in got.items()} == want
    assert got["single"].adi == 12 and got["single"].cv2 == 0
    assert got["lumpy"].cv2 == pytest.approx((9.5 / 10.5) ** 2) and got["lumpy"].adi == 2


def test_sparse_panel_with_known_length_gives_the_same(make_panel):
    p = make_panel({k: v for k, v in CASES.items() if k != "all_zero"})
    dense = {r.s: tuple(r) for r in T.adi_cv2(p, ["s"]).collect()}
    sparse = {r.s: tuple(r) for r in T.adi_cv2(p.where("qty > 0"), ["s"], n_periods=12).collect()}
    assert dense == sparse


def test_interval_histogram_acf_and_trend(make_panel):
    p = make_panel({"every_third": [3, 0, 0] * 4, "constant": [4] * 12, "line": [2 * i + 5 for i in range(12)]})
    assert [tuple(r) for r in T.intervals(p, ["s"], "month").where("s = 'every_third'").collect()] == [("every_third", 3, 3)]
    acf = {(r.s, r.lag): r.acf for r in T.acf(p, ["s"], 2).collect()}
    assert acf["constant", 1] is None and acf["line", 1] == pytest.approx(0.75)
    fit = {r.s: r for r in T.trend(p, ["s"], "month").collect()}
    assert (fit["line"].slope, fit["line"].intercept, fit["line"].r2) == pytest.approx((2, 5, 1))
    assert fit["constant"].slope == pytest.approx(0)


@pytest.mark.parametrize("m", [4, 3])
def test_decompose_returns_a_planted_season(make_panel, m):
    index = [5, -2, -4, 1] if m == 4 else [3, -1, -2]
    first = month(0).year * 12
    p = make_panel({"a": [50 + index[(first + i) % m] for i in range(24)]})
    d = T.decompose(p, ["s"], "month", m)
    rows = d.where(F.col("trend").isNotNull()).collect()
    assert all(abs(r.seasonal - index[r.position]) < 1e-9 and abs(r.remainder) < 1e-9 for r in rows)
    assert len(rows) == 24 - 2 * (m // 2)
    s = T.strengths(d, ["s"]).first()
    assert s.seasonal_strength == pytest.approx(1)


def test_planted_promo_uplift(spark):
    rows = [("a", month(i), 20.0 if i % 3 == 0 else 10.0, 1.0 if i % 3 == 0 else 0.0) for i in range(12)]
    p = spark.createDataFrame(rows, "s string, period date, qty double, promo double")
    assert T.promo_uplift(p, ["s"]).first().uplift == 2.0


def test_abc_ties_go_by_key(spark):
    df = spark.createDataFrame([("d", 10), ("b", 40), ("a", 40), ("c", 10)], "k string, v long")
    got = {r.k: (r.share_before, r.abc) for r in R.classify_abc(df, ["k"], "v", cuts=(0.4, 0.85)).collect()}
    assert got == {"a": (0.0, "A"), "b": (0.4, "B"), "c": (0.8, "B"), "d": (0.9, "C")}


def test_lifecycle(make_panel):
    p = make_panel({"new": [0] * 10 + [1, 1], "active": [1] * 12, "dormant": [1] * 8 + [0] * 4, "ended": [1] * 3 + [0] * 9, "unborn": [0] * 12})
    got = {r.s: r.stage for r in R.lifecycle(p, ["s"], "month", month(11), new_n=6, dormant_n=3, ended_n=6).collect()}
    assert got == {k: k for k in got} and len(got) == 5


def test_rules_first_match_wins(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 5.0), ("d", None)], "s string, x double")
    rules = spark.createDataFrame(
        [(2, "mid", 1.5, 4.0), (1, "low", None, 1.5), (3, "any-high", 1.0, None)], "priority int, label string, x_lo double, x_hi double"
    )
    got = {r.s: r.label for r in R.classify_rules(df, rules, ["x"]).collect()}
    assert got == {"a": "low", "b": "mid", "c": "any-high", "d": "unmatched"}


def test_thousands_of_rules(spark):
    df = spark.range(3000).select("id", (F.col("id") + 0.5).alias("x"))
    rules = spark.range(2000).selectExpr("CAST(2000 - id AS INT) AS priority", "concat('r', id) AS label", "CAST(id AS DOUBLE) AS x_lo", "CAST(NULL AS DOUBLE) AS x_hi")
    got = {r.id: r.label for r in R.classify_rules(df, rules, ["x"]).collect()}
    assert got == {i: f"r{min(i, 1999)}" for i in range(3000)}
    with pytest.raises(TooLarge):
        R.classify_rules(df, rules, ["x"], most=1999)


def test_no_demand_has_no_variation(make_panel):
    row = T.adi_cv2(make_panel({"a": [0, 0, 0]}), ["s"]).first()
    assert row.adi is None and row.cv2 is None


def test_transitions_cover_every_series(make_panel):
    p = make_panel({"stay": [4] * 12, "fade": [4] * 6 + [4, 0, 0, 4, 0, 0]})
    got = {(r.from_segment, r.to_segment): r.series for r in R.transitions(p, ["s"], month(6)).collect()}
    assert got == {("smooth", "smooth"): 1, ("smooth", "intermittent"): 1}


def test_seasonal_share_sums_to_one(make_panel):
    row = T.seasonal_share(make_panel({"a": range(24)}), ["s"]).first()
    assert math.isclose(sum(row[f"month_{i}"] for i in range(1, 13)), 1)
