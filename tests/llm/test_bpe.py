import hashlib
import random

import pytest

from shelfcast.llm import bpe

from .edge import LONG, ROWS, frame

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.public_vocabulary())


@pytest.fixture(scope="module")
def theirs(codec):
    return tiktoken.Encoding("own", pat_str=bpe.public_vocabulary()[1], mergeable_ranks=codec.v.rank, special_tokens={})


def ids(packed):
    return memoryview(packed).cast("I").tolist()


def test_random_texts_as_the_library(codec, theirs):
    random.seed(11)
    for _ in range(2000):
        text = "".join(random.choice("aaabbthe  \n\n'tsé中😀0019..--\x00​") for _ in range(random.randrange(80)))
        packed = codec.encode(text)
        assert ids(packed) == theirs.encode_ordinary(text)
        assert codec.decode(packed).decode() == text


def test_long_runs_without_a_break(codec, theirs):
    for text in ("a" * 3000, "ab" * 1000, "=" * 2500, " " * 999, "é" * 700, LONG[:30_000]):
        assert ids(codec.encode(text)) == theirs.encode_ordinary(text)


def test_prefixes_appends_and_edits(codec):
    random.seed(2)
    for _ in range(100):
        piece = bytes(random.choice(b"abcthe in-") for _ in range(random.randrange(1, 40)))
        table = bpe.Prefixes(codec.v, piece)
        for n in range(len(piece) + 1):
            assert table.tokens(n) == codec.v.merge(piece[:n])
        more = b"thing" * random.randrange(3)
        table.append(more)
        assert table.tokens() == codec.v.merge(piece + more)
        a = random.randrange(len(piece))
        b = random.randrange(a, len(piece) + 1)
        table.replace(a, b, b"the")
        assert table.tokens() == codec.v.merge(piece[:a] + b"the" + piece[b:] + more)


def test_documents(spark, theirs):
    got = bpe.encode_documents(frame(spark), *bpe.public_vocabulary(), ["doc_id"], ids=True).collect()
    assert len(got) == len(ROWS)
    want = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(), theirs.encode_ordinary(r[1] or "")) for r in ROWS)
    assert sorted((str(r.doc_id), r.decoded_sha256, r.ids) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()
    assert bpe.encode_documents(frame(spark, []), *bpe.public_vocabulary(), ["doc_id"]).count() == 0
