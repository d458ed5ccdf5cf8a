import collections
import math
import random
import re

import numpy as np

from shelfcast.llm import maxsketch as ms

from .edge import LONG, ROWS, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, word string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    """All scores of all documents by the formulas."""
    held = [(r[0], collections.Counter(terms(r[1]))) for r in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    rows, total = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(terms(text)), []
        for i, c, n in held:
            m = 25 + 75 * n * rows // total
            s = sum(k * math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if s:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "own") for i, t in items], ITEMS)


def test_terms_as_the_pattern():
    for t in ("Don't STOP-me_now 3.14 É ß İ 中文 a\x00b\x7fc `x` {y}", "", None, "...", LONG[:100], "".join(map(chr, range(300)))):
        assert [x.decode() for x in ms.terms_of(t)] == terms(t)


def test_sketch_bounds_every_term():
    rng = random.Random(2)
    for n in (1, 16, 17, 300):
        c = {f"t{rng.randrange(10**6)}".encode(): rng.choice([1, 2, 3, 254, 255, 256, 9000]) for _ in range(n)}
        s = ms.sketch(list(c), list(c.values()))
        assert len(s) >= 8 * len(c) and len(s) & (len(s) - 1) == 0
        for t, at in zip(c, ms.places(ms.hashes(list(c)), len(s) // 2).T):
            assert at[0] < len(s) // 2 <= at[1] and min(s[i] for i in at) >= min(c[t], 255)


def test_bounds_are_never_under_scores():
    rng = random.Random(3)
    texts = [[f"w{int(rng.paretovariate(0.7)) % 400}".encode() for _ in range(rng.choice([3, 40, 900]))] for _ in range(200)]
    held = [collections.Counter(t) for t in texts]
    df = collections.Counter(t for c in held for t in c)
    asked = [(i, [rng.choice(list(df)) for _ in range(rng.randrange(1, 30))]) for i in range(20)]
    q = ms.Queries(asked, dict(df), len(texts), sum(map(len, texts)))
    for c, words in zip(held, texts):
        m = ms.length_part(len(words), q.rows, q.total)
        bounds = q.bounds(np.frombuffer(ms.sketch(list(c), list(c.values())), "uint8")[None], np.array([m]))[0]
        assert all(bounds[i] >= q.score(i, c, m) for i in range(len(asked)))


def test_few_are_scored_exactly():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(1000)]
    held = [collections.Counter(ms.terms_of(t)) for t in texts]
    df = collections.Counter(t for c in held for t in c)
    q = ms.Queries([(0, ms.terms_of(" ".join(texts[7].split()[:30])))], dict(df), 1000, 100_000)
    best = ms.Best(q, 10)
    m = np.array([ms.length_part(100, 1000, 100_000)] * 1000)
    widths = collections.defaultdict(list)
    for j, c in enumerate(held):
        widths[len(s := ms.sketch(list(c), list(c.values())))].append((j, s))
    for some in widths.values():
        block = np.frombuffer(b"".join(s for _, s in some), "uint8").reshape(len(some), -1)
        best.offer(q.bounds(block, m[: len(some)]), lambda k: (some[k][0], some[k][0], held[some[k][0]], int(m[0])))
    assert best.kept[0][0][2] == 7 and best.scored < 200


def test_as_brute_force(spark):
    rng = random.Random(5)
    pick = lambda: f"w{int(rng.paretovariate(0.6)) % 500}"
    docs = [(i, " ".join(pick() for _ in range(rng.choice([1, 8, 60, 700]))), "en", "s", 0) for i in range(400)]
    docs += [(1000 + i, "the same words in a large group of copies", "en", "s", 0) for i in range(200)]
    docs += ROWS + [(2000, "very " * 300 + "often", "en", "s", 0)]
    items = [(i, " ".join(pick() for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    items += [(50, "the SAME group group"), (51, "unknownword"), (52, None), (53, ""), (54, "alpha beta"), (55, "very often very"), (None, "a row")]
    df = frame(spark, docs)
    for n in (1, 9):
        found = ms.search(ms.index(df.repartition(n)), items_of(spark, items))
        assert got(found) == brute(docs, items)
    assert got(ms.search(ms.index(df), items_of(spark, items * 2), top=3)) == brute(docs, items, 3)


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"red w{i % 7} w{i % 5}", "en", "s", 0) for i in range(60)]
    items = [(i, f"w{i} red") for i in range(12)]
    indexed = ms.index(frame(spark, docs))
    monkeypatch.setattr(ms, "QUERIES", 5)
    assert got(ms.search(indexed, items_of(spark, items))) == brute(docs, items)
    assert ms.search(indexed, items_of(spark, [])).count() == 0
    for none in (frame(spark, []), frame(spark, [(1, "--", "en", "s", 0), (2, None, "en", "s", 0)])):
        assert ms.search(ms.index(none), items_of(spark, items)).count() == 0
