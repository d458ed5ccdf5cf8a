import collections
import math
import random
import zlib

import numpy as np
import pytest

from shelfcast.llm import langid

from .edge import ROWS, frame

SYLLABLES = {"aa": "ka lo mi tu", "bb": "shre gron dwal eth", "cc": "éli ção nhu ões"}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, lang) for lang in SYLLABLES for t in texts(lang, 120, 1)]
    return frame(spark, [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)])


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_held_out_accuracy(docs, model):
    got = langid.identify(docs, model, ["doc_id", "lang", "hash"]).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert len(got) == 360 and len(held) > 40
    assert (held.lang_pred == held.lang).all()
    assert got.score.between(0, 1).all() and not got.rejected.any()


def test_probabilities_add_up_to_one(model):
    """Over all symbols after any context, seen or not; symbols that a model lacks all have one probability."""
    for m in model.models:
        symbols = np.array(sorted({ord(c) for c in "abcdefghijklmnopqrstuvwxyzçéãõ "} | {0x4E00}), "uint32")
        for context in ("kal", "  s", "zzz", "ção"):
            columns = [np.full(len(symbols), ord(c), "uint32") for c in context] + [symbols]
            p = np.exp2(m.log2(columns))
            assert p[:-1].sum() + p[-1] * (1 / langid.UNIFORM - len(symbols) + 1) == pytest.approx(1, abs=1e-6)


def reference(texts):
    """log2 probability of the fourth of four symbols, by textbook counts in dictionaries."""
    grams = collections.Counter()
    for t in texts:
        padded = "   " + "".join(clean(t))
        grams.update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    levels = {4: grams}
    for k in (3, 2, 1):
        # how many distinct symbols precede a sequence
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def p(g):
        if not g:
            return langid.UNIFORM
        counts = levels[len(g)]
        n1, n2 = (sum(c == i for c in counts.values()) for i in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        follow = [c for h, c in counts.items() if h[:-1] == g[:-1]]
        if not follow:
            return p(g[1:])
        return max(counts[g] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(g[1:])

    return lambda g: math.log2(p(g))


def clean(t):
    out = []
    for c in t.lower():
        c = c if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return out


def test_probabilities_by_plain_counts():
    some = texts("bb", 25, 3) + ["Shre, gron!", "x"]
    pieces = [langid.windows(s) for t in some for s in langid.symbols(t)]
    columns = [np.concatenate(c) for c in zip(*pieces)]
    first, index = langid.distinct(columns)
    model = langid.KneserNey(np.stack([c[first] for c in columns], axis=1), np.bincount(index))
    log2 = reference(some)
    for g in ("  sh", "gron", "dwal", "ethx", "zzzz", "n et", "e gr", " x  ", "shrq"):
        assert model.log2([np.array([ord(c)], "uint32") for c in g])[0] == pytest.approx(log2(g))


def test_entropy_by_hand(model):
    """Text by text and character by character."""
    some = ["Kalo, MITU!\n42 kalo", "x", "ÉLI  ção"]
    bits, n = langid.entropies(model.models, some)
    for t, got, count in zip(some, bits, n):
        clean = []
        for c in t.lower():
            c = c if c.isalpha() else " "
            if c != " " or (clean and clean[-1] != " "):
                clean.append(c)
        assert count == len(clean)
        s = [" "] * 3 + clean
        for m, value in zip(model.models, got):
            each = [m.log2([np.array([ord(c)], "uint32") for c in s[i - 3 : i + 1]])[0] for i in range(3, len(s))]
            assert value == pytest.approx(-sum(each) / len(clean))


def test_pieces_give_the_same(model, monkeypatch):
    t = texts("bb", 1, 7)[0] * 20
    whole = langid.entropies(model.models, [t, "kalo"])
    monkeypatch.setattr(langid, "PIECE", 17)
    parts = langid.entropies(model.models, [t, "kalo"])
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_rejection(spark, model):
    strange = ["Съешь ещё этих мягких французских булок, да выпей чаю " * 3, "qxzqjwvkqzxj xqzj wvkqq zxjqxzqjwvkqzxjxqzjwvkqqzxj " * 4, "", None, "123 --- !"]
    got = [model.predict([t]) for t in strange]
    assert all(g["rejected"][0] for g in got)
    assert [g["lang_pred"][0] for g in got[2:]] == ["und"] * 3 and [g["score"][0] for g in got[2:]] == [0.0] * 3
    fresh = [t for lang in SYLLABLES for t in texts(lang, 100, 9)]
    assert not any(model.predict(fresh)["rejected"])


def test_junk_that_carries_labels(spark):
    """One in twenty texts of each language is junk with a label; unseen junk goes and clean texts stay."""
    rng = random.Random(12)
    junk = lambda: " ".join("".join(rng.choices("qxzjwvkfpyžøßþ", k=rng.randrange(3, 9))) for _ in range(rng.randrange(8, 60)))
    rows = [(junk() if i % 20 == 0 else t, lang) for lang in SYLLABLES for i, t in enumerate(texts(lang, 300, 5))]
    dirty = langid.fit(frame(spark, [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)]))
    rejected = dirty.predict([junk() for _ in range(200)])["rejected"]
    kept = ~dirty.predict([t for lang in SYLLABLES for t in texts(lang, 100, 6)])["rejected"]
    assert rejected.mean() >= 0.9 and kept.mean() >= 0.99


def test_a_single_language(spark):
    one = langid.fit(frame(spark, [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts("aa", 120, 1))]))
    assert not one.predict(texts("aa", 50, 4))["rejected"].any() and one.predict(["qxzj wvkf pyqx zjwv " * 5])["rejected"].all()


def test_language_is_no_input(spark, docs, model):
    a = langid.identify(docs, model, ["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    b = langid.identify(docs.withColumns({"lang": docs.source, "source": docs.lang}), model, ["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    assert a.equals(b)


def test_edges(spark):
    docs = frame(spark)
    got = langid.identify(docs, langid.fit(docs), ["doc_id"]).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got if r.lang_pred == "und") == ["3", "4", "5", "8"]
    none = frame(spark, [])
    assert langid.identify(none, langid.fit(none), ["doc_id"]).count() == 0
    unlabelled = frame(spark, [(1, "some text", None, "a", 9)])
    assert langid.identify(unlabelled, langid.fit(unlabelled), ["doc_id"]).first().lang_pred == "und"
