import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import reconcile as M

LEVELS = [[], ["a"], ["b"], ["a", "b"]]
DAYS = [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)]


@pytest.fixture(scope="module")
def case(spark):
    """Demand of 6 x 5 leaves that adds up, and forecasts of all nodes with noise of known variance."""
    rng = np.random.default_rng(1)
    keys = [(f"a{i}", j if j else None) for i in range(6) for j in range(5)]
    names = [M_name(level, k) for level in LEVELS for k in dict.fromkeys(restricted(level, k) for k in keys)]
    s = np.array([[float(n in {M_name(level, restricted(level, k)) for level in LEVELS}) for k in keys] for n in names])
    truth = s @ rng.gamma(2, 10, (len(keys), len(DAYS)))
    var = rng.gamma(2, 4, len(names)) * np.where(s.sum(axis=1) > 1, 0.3, 1)
    base = truth + rng.normal(size=truth.shape) * np.sqrt(var)[:, None]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "keys": keys, "names": names, "s": s, "truth": truth, "var": var, "base": base,
        "leaves": frame(keys, "a string, b int"),
        "base_df": frame([(n, d, float(base[i, j])) for i, n in enumerate(names) for j, d in enumerate(DAYS)], "node string, period date, yhat double"),
        "var_df": frame([(n, float(v)) for n, v in zip(names, var)], "node string, var double"),
    }


def restricted(level, key):
    return tuple(v for c, v in zip("ab", key) if c in level)


def M_name(level, values):
    show = lambda v: "null" if v is None else f'"{v}"' if isinstance(v, str) else str(v)
    values = values if len(values) == len(level) else restricted(level, values)
    return "{" + ",".join(f'"{c}":{show(v)}' for c, v in zip(level, values)) + "}"


def leaves_of(rows):
    return {(r.a, r.b, r.period): r.yhat for r in rows if r.level == "a_b"}


def test_equals_the_algebra_and_beats_bottom_up(spark, case):
    s, w = case["s"], np.diag(1 / case["var"])
    want = np.linalg.solve(s.T @ w @ s, s.T @ w @ case["base"])
    for dense in (2000, 0):
        rows = M.min_trace(case["base_df"], case["var_df"], case["leaves"], LEVELS, dense).collect()
        got = leaves_of(rows)
        assert len(rows) == (30 + 6 + 5 + 1) * 3
        for i, (a, b) in enumerate(case["keys"]):
            for j, d in enumerate(DAYS):
                assert got[a, b, d] == pytest.approx(want[i, j], abs=1e-6)
    leaf = case["base"][-30:]
    assert ((s @ want - case["truth"]) ** 2).sum() < ((s @ leaf - case["truth"]) ** 2).sum()


def test_levels_add_up(case):
    rows = M.min_trace(case["base_df"], case["var_df"], case["leaves"], LEVELS).collect()
    for d in DAYS:
        total = [r.yhat for r in rows if r.level == "total" and r.period == d]
        for level in ("a", "b", "a_b"):
            assert sum(r.yhat for r in rows if r.level == level and r.period == d) == pytest.approx(total[0])


def test_what_is_missing(spark, case):
    """A node without a forecast is the sum of its leaves; without upper forecasts nothing changes."""
    only = case["base_df"].where(F.col("node").contains('"b"') & F.col("node").contains('"a"'))
    got = leaves_of(M.min_trace(only, case["var_df"], case["leaves"], LEVELS).collect())
    for i, (a, b) in enumerate(case["keys"]):
        assert got[a, b, DAYS[0]] == pytest.approx(case["base"][12 + i, 0])
    part = case["base_df"].where((F.col("node") != "{}") | (F.col("period") != F.lit(DAYS[0])))
    less = M.min_trace(part, case["var_df"].where("node <> '{\"a\":\"a0\"}'"), case["leaves"], LEVELS)
    assert less.count() == 42 * 3
    assert M.min_trace(case["base_df"].limit(0), case["var_df"], case["leaves"], LEVELS).count() == 0
