import numpy as np
import pytest

from shelfcast.operators import pooling as P, props as R
from tests.conftest import month


def plain(y, noise):
    """The blend of each item of one group, from lists of demand."""
    n = np.array([len(v) for v in y], float)
    some = n > 0
    rate = np.array([np.mean(v) if len(v) else 0.0 for v in y])
    total, mean = n.sum(), sum(map(sum, y)) / n.sum()
    within = mean if noise == "poisson" else sum(((np.array(v) - r) ** 2).sum() for v, r in zip(y, rate)) / (total - some.sum())
    scatter = (n * (rate - mean) ** 2)[some].sum()
    between = max((scatter - (some.sum() - 1) * within) / (total - (n**2).sum() / total), 0)
    weight = n / (n + within / between) if between else np.zeros(len(n))
    return weight * rate + (1 - weight) * mean


@pytest.mark.parametrize("noise", P.NOISE)
def test_blend_by_hand_and_items_without_history(spark, make_panel, noise):
    rng = np.random.default_rng(1)
    y = {f"i{k}": rng.poisson(rng.gamma(2, 2), rng.integers(1, 9)).tolist() for k in range(20)}
    items = spark.createDataFrame([(s, "g", "x") for s in [*y, "new"]] + [("far", "none", "x"), ("odd", None, "x"), ("solo", "one", "x")], "s string, g string, rate string")
    p = make_panel({**y, "solo": [4, 4, 4], "stranger": [9]})
    got = {r.s: r for r in P.pooled_rates(items, p, ["s"], ["g"], noise).collect()}
    want = plain([*y.values(), []], noise)
    assert len(got) == 24 and [got[s].rate for s in [*y, "new"]] == pytest.approx(want.tolist())
    assert got["new"].own is None and got["new"].weight == 0 and got["solo"].rate == 4
    # a group without history takes the mean of all listed items
    every = np.mean([v for x in [*y.values(), [4, 4, 4]] for v in x])
    assert got["far"].rate == got["odd"].rate == pytest.approx(every)
    assert P.pooled_rates(items.limit(0), p, ["s"], ["g"]).count() == 0
    assert [r.rate for r in P.pooled_rates(items, p.limit(0), ["s"], ["g"]).collect()] == [0.0] * 24


def test_pooling_beats_own_means_on_planted_rates(spark, make_panel):
    rng = np.random.default_rng(2)
    rates = rng.gamma(3, 0.5, 300)
    p = make_panel({f"i{k}": rng.poisson(r, 4).tolist() for k, r in enumerate(rates)})
    items = spark.createDataFrame([(f"i{k}", "g") for k in range(300)], "s string, g string")
    got = {r.s: r for r in P.pooled_rates(items, p, ["s"], ["g"]).collect()}
    error = lambda c: np.mean([(getattr(got[f"i{k}"], c) - r) ** 2 for k, r in enumerate(rates)])
    assert error("rate") < 0.8 * error("own")
    # prior of the planted gamma: mean 1.5, variance 0.75
    prior = P.group_priors(P.item_sums(p.selectExpr("s", "'g' AS g", "period", "qty"), ["s", "g"]), ["g"]).first()
    assert prior["mean"] == pytest.approx(1.5, abs=0.15) and prior.between == pytest.approx(0.75, abs=0.25)
    fc = P.forecast_pooled(items, p, ["s"], ["g"], "month", month(3), 2).collect()
    assert len(fc) == 600 and {r.period for r in fc} == {month(4), month(5)}


def test_properties_of_any_shape(spark):
    rows = [
        (1, '{"k": 3, "who": {"name": "a", "age": 1.5}}'), (2, '{"k": 4, "tags": [1, 2], "a b.c": true}'), (3, "{broken"), (4, None),
        (5, '{"k": "text"}'), (6, "[]"), (7, '{"who": {"name": null}, "K2": 9007199254740993}'), (7, '{"who": {"name": null}, "K2": 9007199254740993}'),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "id int, props string, props_k2 string")
    got = R.columns_of(df, "props")
    assert {c.lower() for c in got.columns} >= {"id", "props", "props_k2", "props_malformed", "props_k", "props_who_name", "props_who_age", "props_tags", "props_a b.c", "props_k2_2"}
    by = {r.id: r.asDict() for r in got.collect()}
    assert got.count() == 8 and [i for i, r in by.items() if r["props_malformed"]] == [3, 6]
    assert by[1]["props_who_name"] == "a" and float(by[1]["props_who_age"]) == 1.5 and by[2]["props_a b.c"] is True
    assert [str(by[i]["props_k"]) for i in (1, 2, 5)] == ["3", "4", "text"] and by[3]["props_k"] is None and by[4]["props_k"] is None
    assert by[7]["props_K2_2"] == 9007199254740993
    assert R.columns_of(df.limit(0), "props").columns == ["id", "props", "props_k2", "props_malformed"]
    with pytest.raises(ValueError):
        R.columns_of(df, "props", most=2)
