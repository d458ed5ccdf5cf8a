import pytest
from pyspark.sql import functions as F

from shelfcast.functions import series as S
from shelfcast.operators import forecast as FC, hybrid as Y
from shelfcast.operators.score import naive_scale, score
from tests.conftest import month


def one(spark, values, model, H=3):
    y = F.lit(None).cast("array<double>") if values is None else F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")
    return spark.range(1).select(y.alias("y")).select(model(F.col("y"), H).alias("f")).first().f


def test_forecasters_by_hand(spark):
    assert one(spark, [10, 12, 8, 11], S.ses(0.3)) == pytest.approx([10.174] * 3)
    assert one(spark, [0, 5, 0, 0, 3, 2], S.croston(0.1)) == pytest.approx([4.52 / 1.99] * 3)
    assert one(spark, [0, 5, 0, 0, 3, 2], S.croston(0.1, "sba")) == pytest.approx([4.52 / 1.99 * 0.95] * 3)
    # demand probability 1/2, then 0.45, 0.405, 0.4645, 0.51805
    assert one(spark, [0, 5, 0, 0, 3, 2], S.croston(0.1, "tsb")) == pytest.approx([4.52 * 0.51805] * 3)
    assert one(spark, [0, 0], S.croston(0.1)) == [0, 0, 0]
    assert one(spark, [1, 2, 3, 4], S.naive(3), 5) == [2, 3, 4, 2, 3]
    assert one(spark, [1, 2], S.naive(3)) is None
    assert one(spark, [1, 2, 6], S.moving_average(2)) == [4, 4, 4]
    assert one(spark, [3], S.moving_average(5)) == [3, 3, 3]
    assert one(spark, [], S.moving_average(5)) is None and one(spark, [], S.ses(0.5)) is None


def test_holt_winters_follows_a_line_and_a_season(spark):
    line = [10 + i for i in range(12)]
    assert one(spark, line, S.holt_winters(2, 0.5, 0.5, 0.5))[0] == pytest.approx(22, abs=0.7)
    season = [10, 20, 30, 10, 20, 30, 10, 20, 30]
    assert one(spark, season, S.holt_winters(3, 0.3, 0.1, 0.2)) == pytest.approx([10, 20, 30])
    assert one(spark, [1, 2, 3], S.holt_winters(3, 0.3, 0.1, 0.2)) is None


def test_forecast_uses_history_up_to_origin_only(make_panel):
    models = {"naive": S.naive(), "ses": S.ses(0.4), "croston": S.croston(0.1), "sba": S.croston(0.1, "sba")}
    a = FC.forecast(make_panel({"a": [1, 0, 3, 4, 5]}), ["s"], "month", [month(2)], 2, models, actuals=True)
    b = FC.forecast(make_panel({"a": [1, 0, 3, 90, 91]}), ["s"], "month", [month(2)], 2, models, actuals=True)
    assert sorted(map(tuple, a.drop("qty").collect())) == sorted(map(tuple, b.drop("qty").collect()))
    assert {(r.h, r.period, r.qty) for r in a.collect()} == {(1, month(3), 4.0), (2, month(4), 5.0)}


def test_series_that_start_late_and_actuals_beyond_the_end(make_panel):
    p = make_panel({"a": [1, 2, 3, 4]}).union(make_panel({"b": [9, 9, 7, 8]}).where(F.col("period") >= month(2)))
    fc = FC.forecast(p, ["s"], "month", [month(1), month(3)], 1, {"naive": S.naive()}, actuals=True)
    got = {(r.s, r.origin): (r.yhat, r.qty) for r in fc.collect()}
    assert got == {("a", month(1)): (2.0, 3.0), ("a", month(3)): (4.0, None), ("b", month(3)): (8.0, None)}


def test_scores_with_zero_denominators(spark):
    rows = [("a", month(0), "m", 1.0, 0.0), ("a", month(1), "m", 0.0, 0.0), ("b", month(0), "m", 3.0, 2.0)]
    fc = spark.createDataFrame(rows, "s string, period date, model string, yhat double, qty double")
    scale = spark.createDataFrame([("a", 0.0), ("b", 0.5)], "s string, scale double")
    got = {r.s: r for r in score(fc, ["s"], ["s"], scale=scale).collect()}
    assert got["a"].wape is None and got["a"].mase is None and got["a"].smape == 2.0 and got["a"].mae == 0.5
    assert (got["b"].mae, got["b"].wape, got["b"].bias, got["b"].mase) == (1.0, 0.5, 1.0, 2.0)


def test_joined_and_carried_actuals_score_alike(make_panel):
    p = make_panel({"a": [1, 5, 2, 7, 3], "b": [0, 0, 4, 0, 1]})
    args = (["s"], "month", [month(1), month(2)], 3, {"naive": S.naive(), "ma": S.moving_average(2)})
    carried = score(FC.forecast(p, *args, actuals=True), ["s"], ["s", "model"])
    joined = score(FC.forecast(p, *args), ["s"], ["s", "model"], actual=p)
    # the two paths add the same numbers in another order
    rows = lambda df: {(r.s, r.model): tuple(r)[2:] for r in df.collect()}
    a, b = rows(carried), rows(joined)
    assert a.keys() == b.keys() and len(a) == 4
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-12), key


def test_naive_scale(make_panel):
    assert naive_scale(make_panel({"a": [1, 4, 2, 50]}), ["s"], month(2)).first().scale == 2.5


def test_tune_finds_the_planted_level(make_panel):
    # a level shift favours a fast level
    p = make_panel({"a": [10] * 6 + [50] * 6})
    t = FC.tune(p, ["s"], "month", [month(7), month(8)], 2, {f"ses_{a}": S.ses(a) for a in (0.1, 0.5, 0.9)})
    assert [r.model for r in t.orderBy("rank").collect()] == ["ses_0.9", "ses_0.5", "ses_0.1"]


@pytest.fixture
def scores(spark):
    rows = [("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", 0.0), ("b", "y", 1.0), ("c", "x", 1.0), ("c", "y", 3.0)]
    return spark.createDataFrame(rows, "s string, model string, mae double")


def test_best_model_and_weights(scores):
    assert {r.s: r.model for r in Y.best_model(scores, ["s"]).collect()} == {"a": "x", "b": "x", "c": "x"}
    w = {(r.s, r.model): r.weight for r in Y.weights(scores, ["s"]).collect()}
    assert w == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 1.0, ("b", "y"): 0.0, ("c", "x"): 0.75, ("c", "y"): 0.25}


def test_combine_route_and_fallback(spark, scores):
    o, p = month(0), month(1)
    rows = [(s, o, m, 1, p, v) for s, m, v in [("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0), ("b", "y", 9.0), ("c", "y", 4.0)]]
    fc = spark.createDataFrame(rows, "s string, origin date, model string, h int, period date, yhat double")
    assert {r.s: r.yhat for r in Y.combine(fc, scores, ["s"]).collect()} == {"a": 2.0, "b": 5.0, "c": 4.0}
    seg = spark.createDataFrame([("a", "smooth"), ("b", "lumpy"), ("c", "other")], "s string, segment string")
    routed = Y.route(seg, {"smooth": "y", "lumpy": "x"}, fc, ["s"])
    assert {r.s: r.yhat for r in routed.collect()} == {"a": 3.0, "b": 5.0, "c": None}
    everywhere = Y.route(seg, {"smooth": "y", "lumpy": "x"}, fc, ["s"], other="y")
    assert {r.s: r.yhat for r in everywhere.collect()} == {"a": 3.0, "b": 5.0, "c": 4.0}
    # a series without a score gets the plain mean
    assert {r.s: r.yhat for r in Y.combine(fc, scores.where("s <> 'a'"), ["s"]).collect()}["a"] == 2.0
    y = fc.where("model = 'y'").select("s", "period", F.when(F.col("s") != "b", F.col("yhat")).alias("yhat"))
    out = Y.fallback({"first": y.where("s = 'a'"), "second": y, "third": fc.where("model = 'x'")}, ["s", "period"])
    assert {r.s: (r.yhat, r.source) for r in out.collect()} == {"a": (3.0, "first"), "b": (5.0, "third"), "c": (4.0, "second")}


def test_reconciled_levels_agree(spark, make_panel):
    p = make_panel({"a": [1, 2, 3], "b": [4, 5, 6]}).withColumn("t", F.lit("all"))
    fc = FC.forecast(p, ["t", "s"], "month", [month(2)], 2, {"ses": S.ses(0.5)})
    up = Y.bottom_up(fc, [[], ["s"]])
    sums = up.groupBy("level", "period").agg(F.sum("yhat").alias("y")).collect()
    assert {r.level for r in sums} == {"total", "s"} and len({round(r.y, 9) for r in sums}) == 1
    total = spark.createDataFrame([(month(3), 42.0)], "period date, yhat double")
    down = {r.s: r.yhat for r in Y.top_down(total, p, ["s"]).collect()}
    assert down == pytest.approx({"a": 12.0, "b": 30.0})


@pytest.fixture(scope="module")
def kinds(make_panel):
    """Never sold, sold before the origin only, new after it, constant, short, and two regular series."""
    p = make_panel({
        "smooth": [10, 11] * 12, "gaps": [5, 0, 0] * 8, "none": [0] * 24, "later": [0] * 22 + [3, 4], "flat": [7] * 24,
    })
    short = make_panel({"short": range(24)}).where(F.col("period") >= F.lit(month(20)))
    unborn = make_panel({"unborn": [2.0] * 24}).where(F.col("period") >= F.lit(month(22)))
    return p.unionByName(short).unionByName(unborn)


SERIES = ["flat", "gaps", "later", "none", "short", "smooth", "unborn"]


def config(**more):
    return Y.HybridConfig(**{
        "keys": ["s"], "freq": "month", "origin": month(21), "horizon": 2, "origins": [month(17), month(19)],
        "models": {"naive": S.naive(), "snaive": S.naive(12), "ses": S.ses(0.3), "croston": S.croston(0.1)},
        "routing": {"smooth": "combined", "intermittent": "best"},
    } | more)


def test_hybrid_gives_every_series_and_step_one_row(kinds):
    rows = Y.hybrid(kinds, config()).collect()
    assert sorted((r.s, r.h) for r in rows) == [(s, h) for s in SERIES for h in (1, 2)]
    assert all(r.yhat is not None and r.origin == month(21) and r.period == month(21 + r.h) for r in rows)
    of = {r.s: r for r in rows if r.h == 1}
    assert of["smooth"].model == "combined" and of["smooth"].source == "routed"
    assert of["none"].yhat == 0 and of["later"].yhat == 0 and of["flat"].yhat == pytest.approx(7)
    # no row up to the origin: no class, no history, no forecast to go by
    assert (of["unborn"].segment, of["unborn"].source, of["unborn"].yhat) == (None, "none", 0.0)
    # two values: too short for the season, so the mean of its class stands in unless it is routed
    assert of["short"].source in ("routed", "segment")


def test_hybrid_sees_no_row_after_the_origin(kinds):
    changed = kinds.withColumn("qty", F.when(F.col("period") > F.lit(month(21)), 999.0).otherwise(F.col("qty")))
    assert sorted(map(tuple, Y.hybrid(kinds, config()).collect())) == sorted(map(tuple, Y.hybrid(changed, config()).collect()))


def test_hybrid_over_other_frames_and_segments(spark, kinds):
    """A frame with a perfect past is chosen by its score; segments may come from anywhere."""
    grid = [(s, month(o), "oracle", h, month(o + h)) for s in SERIES for o in (17, 19, 21) for h in (1, 2)]
    frame = spark.createDataFrame(grid, "s string, origin date, model string, h int, period date")
    truth = kinds.select("s", "period", F.col("qty").alias("yhat"))
    frame = frame.join(truth, ["s", "period"], "left").where("s <> 'flat'")
    segments = spark.createDataFrame([(s, "cluster 1") for s in SERIES[:-1]], "s string, segment string")
    cfg = config(routing={"cluster 1": "best"}, frames=(frame,), segments=segments, other="oracle")
    rows = {(r.s, r.h): r for r in Y.hybrid(kinds, cfg).collect()}
    assert len(rows) == len(SERIES) * 2
    assert rows["gaps", 1].model == "croston" or rows["gaps", 1].yhat == 0.0
    assert rows["smooth", 1].model == "oracle" and rows["smooth", 1].yhat == 10.0
    assert rows["flat", 1].model != "oracle" and rows["unborn", 1].model == "oracle"


def test_hybrid_makes_the_panel_once_beside_its_store(kinds):
    """Names, classes and segment means read the stored panel; only the arrays are made from the panel itself."""
    relations = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RDD")
    assert relations(Y.hybrid(kinds, config())) == relations(kinds)
