import random

import pytest

import numpy as np

import corpus_pipeline as cp
from shelfcast.functions.runtime import durable
from shelfcast.llm import near
from shelfcast.llm.common import components

from .edge import frame

SF = "/root/testdata/sf0.001"


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b)


def edited(words, changes, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def planted():
    """An original and one copy of 60 to 400 words, with up to one word in 16 changed."""
    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        pairs.append((" ".join(words), " ".join(edited(words, rng.randrange(1, 2 + len(words) // 16), rng))))
    return pairs


def test_shingles_are_sets():
    for t in ("a b c d e f a b c d e", "one two", "One TWO", "a b c d e"):
        assert len(near.shingles(t)) == len(plain(t))
    assert (near.shingles("one two") == near.shingles("One  TWO")).all() and not len(near.shingles(None))


def test_near_copies_go_and_others_stay(spark, planted):
    docs = frame(spark, [(2 * i + k, t, "en", "s", 1) for i, pair in enumerate(planted) for k, t in enumerate(pair)])
    kept = {r.doc_id for r in cp.near_copies(spark, docs, SF).collect()}
    at = [similarity(*pair) for pair in planted]
    assert sum(s >= 0.8 for s in at) >= 30 and sum(s < 0.7 for s in at) >= 30
    assert all(2 * i in kept for i in range(len(planted)))
    assert not [i for i, s in enumerate(at) if s >= 0.8 and 2 * i + 1 in kept]
    # SimHash alone may link a few of these
    assert sum(2 * i + 1 in kept for i, s in enumerate(at) if s < 0.7) >= 0.9 * sum(s < 0.7 for s in at)


def test_near_copies_broadcast_no_variants_of_fingerprints(spark, monkeypatch):
    """The variants are estimated under the threshold, while the halves that occur are counted as above it."""
    real, plans = near.simhash_ball.with_neighbours, []

    def noted(fps):
        found = real(fps)
        found.collect()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(near.simhash_ball, "with_neighbours", noted)
    rng = random.Random(9)
    docs = frame(spark, [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(8)), "en", "s", 1) for i in range(3000)], clashing=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        assert cp.near_copies(spark, docs, SF).count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "Broadcast" not in plans[0]


def classes(spark, texts):
    """Smallest place reached, per distinct text, by ``near.links``."""
    df = durable(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    described = durable(near.describe(df, ["node"]))
    sets = lambda nodes: near.shingle_sets(df.join(nodes, "node"), ["node"])
    root = {r.node: r.root for r in components(near.links(described, sets)).collect()}
    return [root.get(i, i) for i in range(len(texts))]


def brute(texts):
    """The same by all pairs, through an inverted index of shingles."""
    sets, held = [plain(t) for t in texts], {}
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for shingle in s:
            for j in held.get(shingle, ()):
                both[j] = both.get(j, 0) + 1
            held.setdefault(shingle, []).append(i)
        for j, n in both.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_pairs_in_a_template_crowd(spark):
    """Texts filled in from one template share bands by the hundred without being linked; the planted pairs among them are."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(400)]
    texts = []
    for k in range(1200):
        # about a third of the shingles of two fillings differ
        words = edited(template, rng.randrange(12, 18), rng)
        texts.append(" ".join(words))
        if k % 24 == 0:
            texts.append(" ".join(edited(words, 4, rng)))
    rng.shuffle(texts)
    want = brute(texts)
    assert 40 <= sum(w != i for i, w in enumerate(want)) < 400
    assert classes(spark, texts) == want


def test_a_large_group_with_stragglers_and_long_texts(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(edited(base, 2, rng)) for _ in range(1500)]
    other = edited(base, 20, rng)
    texts += [" ".join(other), " ".join(edited(other, 1, rng))]
    long = [f"l{rng.randrange(4000)}" for _ in range(30_000)]
    texts += [" ".join(long), " ".join(edited(long, 100, rng)), "", "one", "one two", " \n"]
    want = brute([t if t.split() else f"none{i}" for i, t in enumerate(texts)])
    assert classes(spark, texts) == want


@pytest.mark.parametrize("two", [False, True])
def test_a_block_by_all_pairs(two, monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 5), np.arange(30)])) for _ in range(40)] + [np.arange(100, 160), np.arange(100, 150)]
    side = np.array([i % 2 for i in range(42)]) if two else np.zeros(42, "int64")
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    linked = {(i, j) for i in range(42) for j in range(i) if (not two or side[i] != side[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.9 * len(np.union1d(sets[i], sets[j]))}
    label = list(range(42))
    for _ in range(42):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    for columns in (7, 4096):
        monkeypatch.setattr(near, "COLUMNS", columns)
        nodes, star = near.compare(np.arange(42), side, two, np.concatenate(sets), offsets, 0.9)
        assert dict(zip(nodes.tolist(), star.tolist())) == {i: x for i, x in enumerate(label) if x != i}
    assert len(linked) > 5
