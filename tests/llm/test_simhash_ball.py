import numpy as np
import pytest

from shelfcast.functions.runtime import durable
from shelfcast.llm import simhash_ball as sb

from .edge import ROWS, frame

xxhash = pytest.importorskip("xxhash")


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(values):
    """Smallest index reached, by all pairs."""
    v = np.array(values, "uint64")
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    label = np.arange(len(v))
    while True:
        after = np.array([label[row].min() for row in near])
        if (after == label).all():
            return label
        label = after


def test_fingerprint_by_hand():
    for t in ("a b c d e a b c", "Two WORDS", "one", "", None, "é ü \x0b x y z " * 40):
        assert sb.fingerprint(t) == plain(t)
    long = "word other third " * 30_000
    assert sb.fingerprint(long) == plain(long)


def test_classes_of_planted_distances(spark):
    rng = np.random.default_rng(8)
    values = [0, 1, 7, 2**64 - 1]
    for _ in range(40):
        v = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        values.append(v)
        for flips in (1, 2, 3, 3, 4, 5):
            values.append(v ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    # a chain of steps of 3 and a dense ball
    chain = [0xABCDEF0123456789]
    for k in range(10):
        chain.append(chain[-1] ^ (0b111 << (6 * k)))
    ball = [0x0F0F0F0F12345678 ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)]
    values += chain + ball + ball[:5]
    found = durable(spark.createDataFrame([(i, sb.signed(v)) for i, v in enumerate(values)], "doc_id long, fp long"))
    got = {r.doc_id: r.component_id for r in found.join(sb.classes(found), "fp").collect()}
    assert [got[i] for i in range(len(values))] == brute(values).tolist()


def test_distances_2_and_3_in_either_half_and_both(spark):
    for bits in ((0, 1, 2), (40, 41, 63), (0, 33), (31, 32, 63), (0, 1, 63), (5,), (62, 63)):
        for start in (0, 1, 0x123456789ABCDEF0):
            values = [start, start ^ sum(1 << b for b in bits)]
            near = sb.with_neighbours(spark.createDataFrame([(sb.signed(v),) for v in values], "fp long"))
            assert near.count() == 2
            assert sb.links(near).count() >= 1


def test_variants_are_not_broadcast(spark):
    """Their estimate is under the threshold while the halves that occur, once counted, are above it."""
    rng = np.random.default_rng(9)
    fps = durable(spark.createDataFrame([(v,) for v in rng.integers(-(2**63), 2**63, 3000).tolist()], "fp long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        near = sb.with_neighbours(fps)
        near.collect()
        assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges(spark):
    found = durable(sb.fingerprints(frame(spark), ["doc_id"]))
    got = found.join(sb.classes(found), "fp").toPandas()
    assert len(got) == len(ROWS)
    of = got.dropna().groupby("doc_id")["component_id"].first()
    assert of[1] == of[2] == 1 and of[3] == of[4] == of[5] == 3
    assert got[got.doc_id.isna()].component_id.isna().all()
    none = durable(sb.fingerprints(frame(spark, []), ["doc_id"]))
    assert none.join(sb.classes(none), "fp").count() == 0
