import hashlib

import numpy as np
import pytest

from shelfcast.functions.runtime import durable
from shelfcast.llm import fingerprint as fq
from shelfcast.llm.catalog import QUERIES

from .edge import ROWS, frame


def test_edits_follow_the_next_document(spark):
    docs = fq.keyed(frame(spark))
    got = {(r.key, r.hash): r for r in fq.with_edits(docs, fq.successors(docs)).collect()}
    distinct = sorted({(r[0] is None, r[0] if r[0] is not None else fq.NO_ID, r.hash, r.text) for r in docs.collect()})
    assert len(got) == len(distinct) == len(ROWS) - 2
    for i, (_, key, h, text) in enumerate(distinct):
        after = distinct[(i + 1) % len(distinct)]
        half = len(text) // 2
        assert got[key, h].edited == text[: len(text) - half] + after[3][:half]
        assert got[key, h].n_chars == len(text)


def test_votes_by_hand(spark):
    """Against votes of the same term hashes in Python."""
    texts = ["a bb ccc bb", " spaced   out\n\nthe the the", "", "   ", "wwwwwwwwwwwwwwwwwwww x", "Ünï 中 😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.fp0, r.fp1) for r in fq.votes(df, ["id"], "text").collect()}
    terms = sorted({w for t in texts for w in t.lower().split()})
    hashes = {r.t: (r.a, r.b) for r in spark.createDataFrame([(t,) for t in terms], "t string").selectExpr("t", "xxhash64(t) a", "xxhash64(t, 1) b").collect()}
    for i, t in enumerate(texts):
        total, want = 0, [0, 0]
        sums = np.zeros((2, 64), "int64")
        for w in t.lower().split():
            weight = 1 + min(len(w), 12) ** 2 // 4
            total += weight
            for j in range(2):
                sums[j] += weight * np.array([(hashes[w][j] >> b) & 1 for b in range(64)])
        for j in range(2):
            word = sum(1 << b for b in range(64) if 2 * sums[j][b] > total)
            want[j] = word - (1 << 64) if word >> 63 else word
        assert got[i] == tuple(want)


@pytest.mark.parametrize("per_list", [5, 4096])
def test_search_is_exact(spark, per_list):
    rng = np.random.default_rng(4)
    seeds = rng.integers(-(2**63), 2**63, (20, 2))
    rows = []
    for k in range(400):
        v = seeds[k % 20].copy()
        for b in rng.integers(0, 128, rng.integers(0, 5)):
            v[b // 64] ^= np.int64(np.uint64(1) << np.uint64(b % 64))
        rows.append((int(v[0]), int(v[1])))
    rows = sorted(set(rows))
    stored = durable(spark.createDataFrame([(a, b, i % 3 + 1) for i, (a, b) in enumerate(rows)], "fp0 long, fp1 long, n long"))
    got = {(r.fp0, r.fp1): r.n for r in fq.within(stored, stored.where("n = 2"), per_list=per_list).collect()}
    v = np.array(rows).astype("int64").view("uint64")
    for i, (a, b) in enumerate(rows):
        if i % 3 == 1:
            near = np.bitwise_count(v ^ v[i]).sum(axis=1) <= 3
            assert got[a, b] == sum(int(k) % 3 + 1 for k in np.flatnonzero(near))
    assert len(got) == sum(i % 3 == 1 for i in range(len(rows)))


@pytest.mark.parametrize("radius,keep", [(0, 1), (3, 1), (6, 1), (6, 2), (10, 2)])
def test_search_within_any_radius(spark, radius, keep):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(-(2**63), 2**63, (12, 2))
    rows = set()
    for k in range(300):
        v = seeds[k % 12].copy()
        for b in rng.integers(0, 128, rng.integers(0, 9)):
            v[b // 64] ^= np.int64(np.uint64(1) << np.uint64(b % 64))
        rows.add((int(v[0]), int(v[1])))
    rows = sorted(rows)
    stored = durable(spark.createDataFrame([(i, a, b, 1 + i % 2, "own") for i, (a, b) in enumerate(rows)], "id long, fp0 long, fp1 long, n long, c string"))
    asked = stored.where("id % 3 = 0")
    got = [(r.fp0, r.fp1, r.found_id, r.n, r.distance) for r in fq.search(stored, asked.unionByName(asked), radius, keep, per_list=50).collect()]
    v = np.array(rows).astype("int64").view("uint64")
    want = []
    for i in range(0, len(rows), 3):
        far = np.bitwise_count(v ^ v[i]).sum(axis=1)
        want += [(*rows[i], int(j), 1 + int(j) % 2, int(far[j])) for j in np.flatnonzero(far <= radius)]
    assert sorted(got) == sorted(want) and len(want) > 100 * (radius > 0)
    if radius > 3:
        counts = {(r.fp0, r.fp1): r.n for r in fq.within(stored, asked, radius).collect()}
        assert sum(counts.values()) == sum(w[3] for w in want)
    assert fq.search(stored, asked.limit(0), radius, keep).count() == fq.search(stored.limit(0), asked, radius, keep).count() == 0


def run(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    return QUERIES["op4_simhash"](spark, f"file://{tmp_path}").toPandas()


def test_edges(spark, tmp_path):
    got = run(spark, tmp_path / "a", None)
    assert len(got) == len(ROWS)
    same = got[got.doc_id.isin([1, 2])]
    assert same.fingerprint.nunique() == 1 and len(same) == 3
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert set(got[got.doc_id.isin([3, 4, 5])].fingerprint) == {"0" * 32}
    assert got[got.doc_id == 3].edited_sha256.item() == hashlib.sha256(b"").hexdigest()


def test_no_documents_and_one(spark, tmp_path):
    assert len(run(spark, tmp_path / "none", [])) == 0
    one = run(spark, tmp_path / "one", [(20, "abcdefg", None, None, 7)])
    assert one.near_next.tolist() == [1.0] and one.n_within.tolist() == [0]
    assert one.edited_sha256.item() == hashlib.sha256(b"abcdabc").hexdigest()


def test_edits_are_nearer_than_neighbours(spark):
    got = QUERIES["op4_simhash"](spark, "/root/testdata/sf0.001").toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.95
