"""Fill-in-middle over seekable compressed texts.

A text is stored as independent zstandard frames that end where a unit ends, beside the cumulative
counts of units, characters and bytes at the end of each frame. A unit is a word with the white
space before it, or white space at the end of the text. To cut at a unit only the frame that holds
it is decompressed; whole texts are read frame after frame, for digests and for finding the marks.
Frames are never parted from their neighbours' order, so any stretch of units is a list of frames
and two cut ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.runtime import durable
from .common import map_texts, table

#: Bytes after which a frame ends at the next unit.
FRAME = 1 << 14
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Shares in percent: documents that are transformed, and those of them with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
LEVEL = 3
STORED = "frames array<binary>, units array<long>, chars array<long>, bytes array<long>, marked boolean"

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The first white space behind a word: a unit ends there.
BEHIND = re.compile(rb"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress, zstandard.ZstdDecompressor().decompress


def units_in(piece: bytes) -> int:
    """Units of a piece that begins where a unit begins."""
    return len(piece.split()) + (piece[-1:].isspace())


def pieces(text: bytes, frame: int = FRAME) -> Iterator[bytes]:
    """The text in pieces of at least ``frame`` bytes that end with a word; the last one is what is left."""
    at = 0
    while at < len(text):
        found = BEHIND.search(text, at + frame) if at + frame < len(text) else None
        # a single piece of white space at the end belongs to the last frame
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class Frames:
    """A text as compressed frames with the counts up to the end of each."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], bytes: list[int]):
        self.frames, self.units, self.chars, self.bytes = frames, units, chars, bytes

    @classmethod
    def of(cls, parts: Iterator[bytes]) -> Frames:
        parts, compress = [p for p in parts if p], _zstd()[0]
        count = lambda f: list(accumulate(map(f, parts)))
        return cls([compress(p) for p in parts], count(units_in), count(lambda p: len(p.decode())), count(len))

    def total(self, counts: list[int]) -> int:
        return counts[-1] if counts else 0

    def slice(self, a: int, b: int) -> Frames:
        """Frames a to b - 1, as they are stored."""
        less = lambda counts: [c - (counts[a - 1] if a else 0) for c in counts[a:b]]
        return Frames(self.frames[a:b], less(self.units), less(self.chars), less(self.bytes))

    def __add__(self, other: Frames) -> Frames:
        more = lambda mine, theirs: mine + [c + self.total(mine) for c in theirs]
        return Frames(self.frames + other.frames, more(self.units, other.units), more(self.chars, other.chars), more(self.bytes, other.bytes))

    def cut(self, unit: int) -> tuple[Frames, Frames]:
        """The first ``unit`` units and the rest. At most one frame is decompressed."""
        i = bisect_left(self.units, unit)
        if not unit or i == len(self.units) or self.units[i] == unit:
            end = i + 1 if unit else 0
            return self.slice(0, end), self.slice(end, len(self.frames))
        piece = _zstd()[1](self.frames[i])
        at = next(islice(WORD.finditer(piece), unit - (self.units[i - 1] if i else 0) - 1, None)).end()
        left, right = Frames.of(iter([piece[:at]])), Frames.of(iter([piece[at:]]))
        return self.slice(0, i) + left, right + self.slice(i + 1, len(self.frames))

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Bytes ``start`` to ``end`` in order, a frame at a time; only frames that hold some are decompressed."""
        end = self.total(self.bytes) if end is None else end
        for i in range(bisect_right(self.bytes, start), len(self.frames)):
            begin = self.bytes[i - 1] if i else 0
            if begin >= end:
                break
            yield _zstd()[1](self.frames[i])[max(0, start - begin) : end - begin]

    def find(self, marks: list[bytes]) -> list[int]:
        """Byte position of each mark, each searched behind the one before it; marks may lie across frames."""
        found, tail, at = [], b"", 0
        for piece in self.stream():
            held, begin = tail + piece, at - len(tail)
            while len(found) < len(marks):
                after = found[-1] + len(marks[len(found) - 1]) - begin if found else 0
                place = held.find(marks[len(found)], max(0, after))
                if place < 0:
                    break
                found.append(begin + place)
            at += len(piece)
            tail = held[-(max(map(len, marks)) - 1) :]
        return found


def pack(docs: DataFrame, keep: list[str], text: str = "text", frame: int = FRAME, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The ``keep`` columns and the text as frames with their counts; ``marked``: it holds one of the marks.

    Texts are read where they lie. A null or empty text has no frame. A unit longer than ``frame``
    bytes lies whole in one frame.
    """

    def compute(texts: list[str | None]) -> dict:
        made = [Frames.of(pieces((t or "").encode(), frame)) for t in texts]
        columns = {c: [getattr(m, c) for m in made] for c in ("frames", "units", "chars", "bytes")}
        return columns | {"marked": [any(m in (t or "") for m in marks) for t in texts]}

    return map_texts(docs, keep, text, STORED, compute)


def _each(packed: DataFrame, keep: list[str], schema: str, compute: Callable[[dict], tuple], **more: Column) -> DataFrame:
    """The ``keep`` columns and what ``compute`` gives for each stored text, a dictionary with ``more`` in it."""
    names = [f.name for f in StructType.fromDDL(schema)]
    fields = [F.col(f.name) for f in StructType.fromDDL(STORED)] + [c.alias(n) for n, c in more.items()]
    rows = packed.select(*[F.col(f"`{c}`") for c in keep], F.struct(*fields).alias("_text"))

    def run(texts: list[dict]) -> dict:
        made = [compute(t) for t in texts]
        return {n: [m[i] for m in made] for i, n in enumerate(names)}

    return map_texts(rows, keep, "_text", schema, run)


def _frames(row: dict) -> Frames:
    return Frames(*[list(row[c]) for c in ("frames", "units", "chars", "bytes")])


def units_between(packed: DataFrame, keep: list[str], start: int, end: int) -> DataFrame:
    """The ``keep`` columns and ``part``: units ``start`` to ``end`` - 1 of each stored text, from the frames that hold them."""

    def compute(row: dict) -> tuple:
        first, _ = _frames(row).cut(end)
        return (b"".join(first.cut(min(start, end))[1].stream()).decode(),)

    return _each(packed, keep, "part string", compute)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of an id. A null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def arrange(text: Frames, marked: bool, h: list[int], marks: tuple[str, str, str] = MARKS) -> tuple[str, Frames, int | None, int | None]:
    """(form, output, characters of the prefix, characters of the middle)."""
    n = text.total(text.units)
    if not n or marked or h[2] % 100 >= TRANSFORMED:
        return "plain", text, None, None
    first, second = sorted(x % (n + 1) for x in h[:2])
    head, suffix = text.cut(second)
    prefix, middle = head.cut(first)
    p, s, m = (Frames.of(iter([x.encode()])) for x in marks)
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    output = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return form, output, prefix.total(prefix.chars), middle.total(middle.chars)


def restored(output: Frames, form: str, marks: tuple[str, str, str] = MARKS) -> Iterator[bytes]:
    """The text again, in order, from the output and its form alone."""
    if form == "plain":
        yield from output.stream()
        return
    order = [marks[i].encode() for i in ((1, 0, 2) if form == "spm" else (0, 1, 2))]
    at = output.find(order)
    ends = [*at[1:], output.total(output.bytes)]
    section = {m: (a + len(m), b) for m, a, b in zip(order, at, ends)}
    for mark in (marks[0], marks[2], marks[1]):
        yield from output.stream(*section[mark.encode()])


def sha256_of(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def transform(packed: DataFrame, keep: list[str], doc_id: str = "doc_id", seed: int = SEED, marks: tuple[str, str, str] = MARKS, output: bool = False) -> DataFrame:
    """The ``keep`` columns, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each stored text.

    With ``output`` also the output itself. Cuts and form are drawn from ``seed`` and the id, so
    rows with one id and equal text get one result. Texts that are empty or hold a mark stay plain.
    """
    schema = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * output

    def compute(row: dict) -> tuple:
        text = _frames(row)
        form, made, prefix, middle = arrange(text, row["marked"], draws(row["doc"], seed), marks)
        found = (text.total(text.units), form, prefix, middle, sha256_of(made.stream()), sha256_of(restored(made, form, marks)))
        return (*found, b"".join(made.stream()).decode()) if output else found

    return _each(packed, keep, schema, compute, doc=F.col(f"`{doc_id}`").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(durable(pack(table(spark, sf_dir, "documents"), ["doc_id"])), ["doc_id"])


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
    least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
    array_to_string(u[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
