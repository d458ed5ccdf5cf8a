"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece of text exactly one token can be the last one of its encoding: the token
whose beginning is a prefix with last token p such that p and the token stay apart when merged. So
a table of last tokens is filled from left to right, and the encoding is read from it backwards.
Appended bytes extend the table; after an edit only the prefixes behind the edit are worked out anew.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

VOCABULARY = "byte_bpe_50k.tiktoken"
NEVER = 1 << 60


class Vocabulary:
    """Tokens by rank. Merges are found from the ranks: a token is made of the two that its bytes give without it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes, below: int = NEVER) -> list[int]:
        """Plain merging with ranks under ``below``; for single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if found[0] >= below:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that no merge makes."""
        if token not in self._parts:
            own = self.bytes[token]
            got = self.merge(own, token) if len(own) > 1 else []
            self._parts[token] = tuple(got) if len(got) == 2 else None
        return self._parts[token]

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(token at that edge, time at which it is merged into the next), from the whole token back to a byte."""
        kept = self._right if right else self._left
        if token not in kept:
            chain, now, until = [], token, NEVER
            while True:
                chain.append((now, until))
                if (two := self.parts(now)) is None:
                    break
                now, until = two[right], now
            kept[token] = chain
        return kept[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether a text of these two tokens is encoded as these two tokens.

        At each time some token ends before the border and some token begins behind it. The border
        goes if the merge of such two comes before either of them is merged into its own token; on
        equal rank the merge further left comes first.
        """
        left, right, i, j = self.edge(a, True), self.edge(b, False), 0, 0
        holds = True
        while holds:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            both = self.rank.get(self.bytes[x] + self.bytes[y], NEVER)
            holds = not (both < NEVER and both < x_ends and both <= y_ends)
            # step back over the later of the two merges that made x and y
            born_x = x if i + 1 < len(left) else -1
            born_y = y if j + 1 < len(right) else -1
            if born_x < 0 and born_y < 0:
                break
            if born_x > born_y:
                i += 1
            else:  # of equal merges the one further left comes first
                j += 1
        if len(self._apart) > 500_000:
            self._apart.clear()
        self._apart[a, b] = holds
        return holds


class Prefixes:
    """Last tokens of all prefixes of a growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        v, last = self.v, self.last
        begin, self.piece = len(self.piece), self.piece + more
        piece, rank, known = self.piece, v.rank.get, v._apart.get
        for end in range(begin + 1, len(piece) + 1):
            for start in range(max(0, end - v.longest), end):
                token = rank(piece[start:end])
                if token is None:
                    continue
                if start:
                    fits = known((last[start - 1], token))
                    if fits is None:
                        fits = v.apart(last[start - 1], token)
                else:
                    fits = end == 1 or v.parts(token)
                if fits:
                    last.append(token)
                    break

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Put ``by`` in place of bytes ``start`` to ``end``; prefixes up to ``start`` are kept."""
        rest = by + self.piece[end:]
        del self.last[start:]
        self.piece = self.piece[:start]
        self.append(rest)

    def tokens(self, upto: int | None = None) -> list[int]:
        """Encoding of the first ``upto`` bytes."""
        end, out = len(self.piece) if upto is None else upto, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes[out[-1]])
        return out[::-1]


class Codec:
    """Encodes whole texts. Pieces are the matches of a pattern; the packed ids of pieces are kept for reuse."""

    def __init__(self, path: str, pattern: str, keep: int = 800_000):
        import regex

        self.v, self.find, self.keep = Vocabulary(path), regex.compile(pattern).findall, keep
        self.packed: dict[str, bytes] = {}

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.v.rank.get(piece)
        if whole is not None and (len(piece) == 1 or self.v.parts(whole)):
            return [whole]
        return Prefixes(self.v, piece).tokens()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.packed, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = b"".join(i.to_bytes(4, "little") for i in self.piece_ids(piece.encode()))
                if len(piece) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def public_vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """(path, pattern) of a vocabulary of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: the ``keep`` columns, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids.

    Documents are read where they lie, without a shuffle. A null text is empty: no tokens and the
    digest of no bytes. ``path`` must be readable on all machines.
    """

    def compute(texts: list[str | None]) -> dict:
        c = codec(path, pattern)
        packed = [c.encode(t) if t else b"" for t in texts]
        return {
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in packed],
        } | ({"ids": [memoryview(p).cast("I").tolist() for p in packed]} if ids else {})

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return map_texts(docs, keep, text, schema, compute)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *public_vocabulary(), ["doc_id"])
