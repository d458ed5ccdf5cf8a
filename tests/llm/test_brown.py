import collections
import inspect
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from shelfcast.functions.runtime import durable
from shelfcast.llm import brown

from .edge import ROWS, frame


def corpus(n, seed=1):
    """Sentences of two kinds of words in turn, so that classes help."""
    rng = random.Random(seed)
    a, b = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    return [" ".join(rng.choice(a if k % 2 else b) for k in range(rng.randrange(4, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return brown.fit(durable(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(corpus(400))])))


def test_classes_beat_single_words(spark, model):
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(corpus(50, 2))])
    got = brown.score(docs, model, ["doc_id"]).toPandas()
    tokens = got.n_tokens.sum()
    assert (got.n_tokens == got.n_known).all()
    # two sets of thirty words in turn, with a class for nearly every word
    assert (got.score.sum() - got.base_score.sum()) / tokens > 0.1


def test_counts_are_those_of_all_texts(model):
    words = collections.Counter(w for t in corpus(400) for w in t.encode().split())
    assert model.tokens == sum(words.values()) + 400 and model.kinds == len(words) + 1
    assert model.pairs.sum() == model.tokens
    assert {w: model.counts[i] for w, i in model.index.items()} == {w: n for w, n in words.items() if n >= brown.LEAST}


def test_probabilities_add_up_to_one(model):
    step = 10.0 ** model.transitions()
    assert np.allclose(step.sum(axis=1), 1)
    per_class = model.pairs.sum(axis=0)
    own = model.symbol < model.moved
    inside = np.bincount(model.classes[model.symbol[own]], model.counts[own], brown.CLASSES)
    assert own.all() and (inside == per_class[: brown.CLASSES]).all()


def test_words_between_the_limits_have_the_class_of_their_ending(spark, monkeypatch):
    monkeypatch.setattr(brown, "MOVED", 60)
    texts = corpus(300, 5) + ["noun1 " * 3000]
    train = durable(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    m = brown.fit(train)
    assert 0 < m.moved < len(m.index)
    per_class = m.pairs.sum(axis=0)
    inside = 10.0 ** m.inside()
    for k in range(len(per_class) - 1):
        of = [i for i in range(len(m.index)) if m.classes[m.symbol[i]] == k]
        # the rest of an ending's class is for one unseen word
        assert sum(inside[of]) + (brown.ADD / m.by_ending()[k - brown.CLASSES] if k >= brown.CLASSES else 0) == pytest.approx(1 if of or k >= brown.CLASSES else 0)
    follow = collections.Counter()
    for t in texts:
        c = [int(m.classes[m.symbol[m.index[w]]]) for w in t.encode().split()]
        follow.update(zip([len(m.pairs) - 1, *c], [*c, len(m.pairs) - 1]))
    assert {(a, b): m.pairs[a, b] for a, b in zip(*np.nonzero(m.pairs))} == dict(follow)


def test_words_of_a_millionth_of_all_tokens_move(spark):
    """Words under 2^-17 of all tokens and above 2^-20, in two kinds that stand beside different words."""
    rng = random.Random(3)
    kinds = {f"{k}{i}": k for k in ("left", "right") for i in range(20)}
    # the byte ends of both kinds are the same
    texts = [f"{kinds[w]}before {w} {kinds[w]}after" for w in kinds for _ in range(9)] + ["common word " * 600_000]
    rng.shuffle(texts)
    m = brown.fit(durable(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])))
    classes = {w: int(m.classes[m.symbol[m.index[w.encode()]]]) for w in kinds}
    assert all(c < brown.CLASSES for c in classes.values())
    assert not {classes[w] for w in kinds if kinds[w] == "left"} & {classes[w] for w in kinds if kinds[w] == "right"}
    assert inspect.signature(brown.fit).parameters["parts"].default == 3


def test_base_and_score_word_by_word(spark, model):
    texts = ["noun1 verb2 noun3", "NOUN1 strange verb9 strange", "", "é ü", None, "noun1\x0bverb1"]
    got = {r.doc_id: r for r in brown.score(frame(spark, [(i, t, "x", "s", 0) for i, t in enumerate(texts)]), model, ["doc_id"]).collect()}
    words = {r.word.encode(): r.n for r in model.words.collect()}
    step, per_class, end = model.transitions(), model.pairs.sum(axis=0), len(model.pairs) - 1
    for i, t in enumerate(texts):
        base, score, before, known = 0.0, 0.0, end, 1
        for w in (t or "").encode().lower().split():
            c = words.get(w, 0)
            known += c > 0
            base += math.log10((c + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
            if w in model.index:
                k = model.classes[model.symbol[model.index[w]]]
                inside = c / per_class[k]
            else:
                k = brown.CLASSES + brown.ending(w)
                inside = (c + 0.1) / model.by_ending()[brown.ending(w)]
            score += step[before, k] + math.log10(inside)
            before = k
        base += math.log10((400 + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
        score += step[before, end]
        assert got[i].base_score == pytest.approx(base, abs=1e-6) and got[i].score == pytest.approx(score, abs=1e-6)
        assert got[i].n_known == known and got[i].train_tokens == model.tokens


def test_best_class_is_the_likeliest():
    """Against the likelihood of every move, counted anew."""
    rng = np.random.default_rng(6)
    words, k = 12, brown.CLASSES + brown.ENDINGS + 1
    pairs = rng.integers(0, 6, (words + 1, words + 1))
    np.fill_diagonal(pairs, 0)
    classes = np.append(rng.integers(0, 4, words), k - 1)
    count = lambda cls: np.array([[pairs[np.ix_(cls == a, cls == b)].sum() for b in range(k)] for a in range(k)])

    def likelihood(m):
        x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
        return x(m.ravel()) - x(m.sum(axis=0)) - x(m.sum(axis=1))

    m = count(classes)
    for w in range(words):
        right, left = np.bincount(classes, pairs[w], k), np.bincount(classes, pairs[:, w], k)
        best = brown.best_classes(classes[w : w + 1], right[None], left[None], m)[0]
        moves = []
        for c in range(6):
            moved = classes.copy()
            moved[w] = c
            moves.append(likelihood(count(moved)))
        at = classes.copy()
        at[w] = best
        assert likelihood(count(at)) == pytest.approx(max(moves))


def test_equal_texts_score_alike_and_edges(spark):
    docs = durable(frame(spark))
    got = brown.score(docs, brown.fit(docs), ["doc_id", "hash"]).toPandas()
    assert len(got) == len(ROWS)
    assert got[got.doc_id.isin([1, 2])].score.nunique() == 1
    assert got[got.doc_id.isin([3, 4, 5])].n_tokens.tolist() == [1, 1, 1]
    none = durable(frame(spark, []))
    model = brown.fit(none)
    assert brown.score(none, model, ["doc_id"]).count() == 0
    lone = brown.score(docs, model, ["doc_id"]).toPandas()
    assert np.isfinite(lone.score).all() and (lone.train_tokens == 0).all() and (lone.n_known == 0).all()


def test_words_are_cut_like_bytes_and_packed_lists_hold_every_pair(spark, monkeypatch):
    """Neighbours in packed lists, and class bigrams that follow the words that moved, against plain counts."""
    monkeypatch.setattr(brown, "STRETCH", 200)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB\u00e9 \x0b\n\t\x1c") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " \n", None, "aa " * 500]
    plain = [(t or "").encode().lower().split() for t in texts]
    got = []
    for part in brown._stretches(pa.array(texts)):
        cuts, ids, words = brown.tokens_of(part)
        words = [w.encode() for w in words.to_pylist()]
        got += [[words[i] for i in ids[a:b]] for a, b in zip(cuts, cuts[1:])]
    assert got == plain

    common = [w for w, _ in collections.Counter(w for t in plain for w in t).most_common(12)]
    moved, parts = 9, 3
    symbol = np.array([i if i < moved else moved + brown.ending(w) for i, w in enumerate(common)])
    size, number = moved + brown.ENDINGS + 1, dict(zip(common, symbol.tolist()))
    pairs = collections.Counter()
    for t in plain:
        s = [size - 1, *(number.get(w, moved + brown.ending(w)) for w in t), size - 1]
        pairs.update(zip(s, s[1:]))
    train = frame(spark, [(i, t, "x", "s", 0) for i, t in enumerate(texts)]).repartition(5)
    around = brown.neighbours(train, pa.array([w.decode() for w in common]), symbol, moved, 2000, parts)
    found = collections.Counter()
    for r in around.collect():
        words, sizes, slots, n = brown._unpack([pa.scalar(bytes(r[c])) for c in ("words", "sizes", "slots", "n")])
        for w, s, m in zip(np.repeat(words, sizes).tolist(), slots.tolist(), n.tolist()):
            assert r.part == (-1 if w >= moved or s == 2 * w else w % parts)
            found[(s // 2, w, "left") if s % 2 else (w, s // 2, "right")] += m
    want = {(a, b, "right"): n for (a, b), n in pairs.items() if a < moved or b >= moved}
    assert found == want | {(a, b, "left"): n for (a, b), n in pairs.items() if b < moved and a != b}

    k = brown.CLASSES + brown.ENDINGS + 1
    ends = np.arange(brown.CLASSES, k)
    before, after = (np.append([rng.randrange(4) for _ in range(moved)], ends) for _ in range(2))
    after[[i for i in range(moved) if i % parts]] = before[[i for i in range(moved) if i % parts]]
    after[0] = (before[0] + 1) % 4

    def bigrams(cls):
        out = np.zeros((k, k), "int64")
        for (a, b), n in pairs.items():
            out[cls[a], cls[b]] += n
        return out

    fixed, own = brown.unmoved_pairs(around, moved)
    first = fixed + brown.class_pairs(around.where("part >= 0"), before, np.arange(size) < moved, k)
    np.add.at(first, (before[:moved], before[:moved]), own)
    assert (first == bigrams(before)).all()
    then = first + brown.class_pairs(around.where("part = 0"), after, after != before, k, before)
    np.add.at(then, (after[:moved], after[:moved]), own)
    np.add.at(then, (before[:moved], before[:moved]), -own)
    assert (then == bigrams(after)).all()


def test_counts_over_a_byte_are_packed():
    for most in (200, 60_000, 4_000_000_000, 2**40):
        row = brown._pack(np.array([3, 3, 7]), np.array([1, 9, 4]), np.array([1, most, 2]))
        words, sizes, slots, n = brown._unpack([pa.scalar(x) for x in row])
        assert (words.tolist(), sizes.tolist(), slots.tolist(), n.tolist()) == ([3, 7], [2, 1], [1, 9, 4], [1, most, 2])
