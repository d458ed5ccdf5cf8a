import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import vectors
from shelfcast.functions.columns import first_full_period, full_period_end, period_index, shift_period
from shelfcast.functions.ranks import exact_quantiles, running_total
from shelfcast.functions.runtime import TooLarge, bounded_rows, checkpoint_dir, durable


def test_periods(spark):
    df = spark.createDataFrame([(dt.date(1995, 1, 1),), (dt.date(1995, 1, 31),)], "d date")
    row = df.select(
        first_full_period(F.min("d"), "week").alias("w"), full_period_end(F.max("d"), "month").alias("m"),
        full_period_end(F.max("d"), "week").alias("we"),
    ).first()
    assert (row.w, row.m, row.we) == (dt.date(1995, 1, 2), dt.date(1995, 2, 1), dt.date(1995, 1, 30))
    for freq in ("day", "week", "month"):
        start = F.lit(dt.date(2020, 3, 1 if freq == "month" else 2))
        gap = period_index(shift_period(start, 5, freq), freq) - period_index(start, freq)
        assert spark.range(1).select(gap.alias("g")).first().g == 5


@pytest.fixture
def many_slices(spark):
    """Keep AQE from merging the small slices of a test into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [0, 200])
def test_running_total_with_a_hot_group(spark, many_slices, hot):
    rng = np.random.default_rng(1)
    rows = [("hot" if i < hot else f"g{i % 3}", i, int(v)) for i, v in enumerate(rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    got = {(r.g, r.i): (r.before, r.total) for r in running_total(df, ["g"], [F.desc("v"), F.asc("i")], "v").collect()}
    assert len(got) == 300
    for g in {r[0] for r in rows}:
        acc = 0
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        for _, i, v in members:
            assert got[g, i] == (acc, sum(m[2] for m in members))
            acc += v


def test_exact_quantiles_against_numpy(spark, many_slices):
    rng = np.random.default_rng(2)
    # one value fills a third of the rows
    a = np.r_[np.zeros(100), rng.normal(size=201)]
    rows = [("a", float(v)) for v in a] + [("b", 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.93}).collect()}
    assert np.allclose([got["a"].lo, got["a"].mid, got["a"].hi], np.quantile(a, [0.1, 0.5, 0.93]))
    assert (got["b"].lo, got["b"].hi, got["b"].n_rows) == (3.0, 3.0, 1)


def _brute(ids, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    out = {}
    for i, q in enumerate(ids):
        near = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[q] = [j for _, j in near]
    return out


@pytest.mark.parametrize("blocked", [False, True])
def test_topk_is_exact_with_many_copies(spark, monkeypatch, blocked):
    if blocked:
        monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vectors, "CHUNK", 7)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 4))
    m[20:40] = m[20]  # a third are copies
    ids = list(range(100, 160))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, m)], "id long, emb array<double>").repartition(3)
    got = {}
    for r in vectors.topk_cosine(df, df, 5, "id", "emb").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    assert got == _brute(ids, m, 5)


def test_bounded_rows_raises_instead_of_cutting(spark):
    assert len(bounded_rows(spark.range(5), 5, "x")) == 5
    with pytest.raises(TooLarge):
        bounded_rows(spark.range(6), 5, "x")


class FakeSession:
    """Just enough of a session to ask where its shared folder is."""

    def __init__(self, master, setting=None):
        self.conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": setting}.get(key) or default)
        self.set_to = None
        self.sparkContext = SimpleNamespace(
            master=master, getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: self.set_to,
            setCheckpointDir=lambda d: setattr(self, "set_to", d),
        )


def test_checkpoint_dir_is_the_clusters_or_an_error():
    assert checkpoint_dir(FakeSession("spark://host", "hdfs://shared/ck")) == "hdfs://shared/ck"
    with pytest.raises(RuntimeError):
        checkpoint_dir(FakeSession("spark://host"))


def test_durable_is_a_table_in_the_shared_folder(spark):
    df = durable(spark.range(3).withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in df.collect()) == [0, 2, 4]
    assert all(checkpoint_dir(spark).removeprefix("file:") in f for f in df.inputFiles())
