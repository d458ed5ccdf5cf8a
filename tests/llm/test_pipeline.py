import collections

import numpy as np
import pytest

import corpus_pipeline as cp
from shelfcast.functions.runtime import durable
from shelfcast.llm import bpe, mixing, simhash_ball

from .edge import ROWS, frame
from .test_mixing import fill
from .test_near import similarity
from .test_simhash_ball import plain

SF = "/root/testdata/sf0.001"


def brute(texts):
    """Smallest index reached by links of either rule: 3 bits, or 0.8 of the five-word shingles."""
    v = np.array([plain(t) for t in texts], "uint64")
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    for i, a in enumerate(texts):
        for j in range(i):
            if not near[i, j] and (a or "").split() and (texts[j] or "").split() and similarity(a, texts[j]) >= 0.8:
                near[i, j] = near[j, i] = True
    label = np.arange(len(v))
    while True:
        after = np.array([label[row].min() for row in near])
        if (after == label).all():
            return label
        label = after


@pytest.fixture(scope="module")
def stages(spark):
    """Output of every stage over the smallest tables, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(durable(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    for df in stages[1:4]:
        assert df.dtypes == stages[0].dtypes


def test_language_keeps_documents_with_letters(stages):
    before, after = ({r["doc_id"]: r for r in rows(df)} for df in stages[:2])
    assert set(after) <= set(before) and len(after) >= 0.99 * len(before)
    assert all(after[i]["text"] == before[i]["text"] for i in after)
    assert sum(after[i]["lang"] == before[i]["lang"] for i in after) >= 0.98 * len(after)


def test_one_of_each_class_stays(stages):
    before = sorted(rows(stages[1]), key=lambda r: r["doc_id"])
    label = brute([r["text"] for r in before])
    assert {r["doc_id"] for r in rows(stages[2])} == {before[i]["doc_id"] for i in set(label)}
    assert stages[2].count() == len(set(label))


def test_mix_meets_its_targets(stages):
    before, after = rows(stages[2]), rows(stages[3])
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    per = collections.Counter()
    for r in before:
        per[r["source"]] += size[r["doc_id"]]
    taken, times = collections.Counter(), collections.Counter()
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3
    for s, target in fill(dict(per)).items():
        # ten documents a source
        assert abs(taken[s] - target) <= 0.03 * target


def test_tokens_of_all_that_is_left(stages):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Vocabulary(path).rank, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in rows(stages[3])}
    got = rows(stages[4])
    assert len(got) == stages[3].count()
    assert all(r["n_tokens"] == len(theirs.encode_ordinary(texts[r["doc_id"]])) for r in got)


def test_edges(spark):
    docs = frame(spark)
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        out.collect()
    kept = cp.near_copies(spark, docs, SF).collect()
    assert len(kept) == len({r[1] if r[0] is None or r[1] and r[1].split() else "" for r in ROWS} - {ROWS[0][1]}) + 1 - _linked()
    assert sum(r.doc_id == 1 for r in kept) == 1 and not any(r.doc_id == 2 for r in kept)
    assert sum(r.doc_id is None for r in kept) == 1
    for _, stage in cp.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0


def _linked():
    """Distinct texts of the edge cases, less their classes."""
    texts = list(dict.fromkeys((r[1] or "").strip() and r[1] or "" for r in ROWS))
    return len(texts) - len(set(brute(texts)))


def test_repeated_copies_of_one_size(spark):
    docs = frame(spark, [(i, "same words here", "en", "hot" if i % 3 else "cold", 15) for i in range(90)])
    kept = cp.near_copies(spark, docs, SF).collect()
    assert [r.doc_id for r in kept] == [0]
    mixed = collections.Counter(r.source for r in cp.mix(spark, docs, SF).collect())
    assert mixed == {s: round(t / 3) for s, t in fill({"hot": 180, "cold": 90}).items()}
    assert mixing.CAP == 3 and simhash_ball.RADIUS == 3
