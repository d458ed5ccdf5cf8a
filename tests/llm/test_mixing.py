import math

import pandas as pd
import pytest

from shelfcast.functions.runtime import durable
from shelfcast.llm import mixing

from .edge import ROWS, frame


def mixed(docs):
    rows = durable(mixing.sized(docs))
    return mixing.copies_of(rows, mixing.plan(rows), "source", "size", "pick").toPandas()


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    held = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in held else share[s] for s in names}
        held |= over


def test_targets_with_cuts_that_cut_others(spark):
    sizes = {"a": 10, "b": 500, "c": 4000, "é": 30, None: 70, "": 100, "😀": 900}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(fill(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_rates_solve_the_constraints(spark):
    cells = pd.DataFrame([("s", z, n) for z, n in ((1, 50), (7, 20), (90, 9), (1500, 2))] + [("t", 10, 100), ("t", 20, 50)], columns=["source", "size", "n"])
    cells = cells.assign(mean=lambda d: d.source.map({"s": 44.8, "t": 13.3}), target=lambda d: d.source.map({"s": 900.0, "t": 5900.0}))
    lam = {r.source: r.lam for r in mixing.solve(spark.createDataFrame(cells)).collect()}
    for s, part in cells.groupby("source"):
        rate = [min(3.0, math.exp(lam[s] * z / m)) for z, m in zip(part["size"], part["mean"])]
        assert sum(r * n * z for r, n, z in zip(rate, part.n, part["size"])) == pytest.approx(part.target.iloc[0], rel=1e-6)


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(1 + pmod(hash(id), 97) * (1 + id % 3) AS INT)) AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 8) END AS source",
    )
    out = mixed(docs)
    assert (out.copies <= 3).all() and (out.copies >= 0).all()
    per = out.assign(taken=out.copies * out["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), whole=("size", "sum"))
    assert ((per.taken / per.target - 1).abs() < 0.01).all()
    want = fill(per.whole.to_dict())
    assert per.target.to_dict() == pytest.approx(want)
    again = mixed(docs)
    assert out.sort_values("doc_id")["copies"].tolist() == again.sort_values("doc_id")["copies"].tolist()


def test_thousands_of_documents_of_one_size(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id < 3000 THEN 'same text' ELSE concat('w ', repeat('x ', CAST(id % 40 AS INT))) END AS text", "CASE WHEN id % 4 = 3 THEN 'b' ELSE 'a' END AS source")
    out = mixed(docs)
    per = out.assign(taken=out.copies * out["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken / per.target - 1).abs() < 0.01).all()


def test_edges(spark):
    out = mixed(frame(spark))
    assert len(out) == len(ROWS) and (out.copies <= 3).all()
    assert out[out.doc_id.isin([3, 4, 5])]["size"].tolist() == [0, 0, 0]
    assert out.groupby("source", dropna=False)["target"].nunique().max() == 1
    assert len(mixed(frame(spark, []))) == 0
    only_empty = mixed(frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)]))
    assert only_empty.target.tolist() == [0.0, 0.0]
