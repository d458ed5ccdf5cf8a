"""Exact duplicates by a tree-merge of sorted digest runs.

Every part of the input becomes a run: its distinct digests in order, each with the row that stays,
and the number of rows. Parts then exchange in binomial rounds. Before round r the digits of a
part's number from r on say where the run was made, those before r which digests it holds. In a
round the parts that differ in one digit only meet: each takes the stretch of digests that belongs
to its digit from all of them and merges these runs into one. So after the last round a part holds
one stretch of all digests, no part ever has more than its share, and equal digests of one part meet
once, however many rows have them. Digests are the whole SHA-256: rows are ordered by its bytes and
joined only if all of them are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runtime import durable
from .common import map_texts, table

#: Parts that exchange in one round, as a power of two.
FAN = 3
#: Digests that one row of a run holds.
BLOCK = 4096
#: Digests that a merge holds beside the blocks of its runs that overlap.
HELD = 1 << 16
ENTRY = np.dtype([("digest", "S32"), ("none", "?"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
BLOCKS = "slot long, low binary, entries binary"


def ascii_lower(text: str | None) -> bytes:
    """A text in UTF-8 with A-Z in lower case; null is empty."""
    return (text or "").encode().lower()


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normal: Callable[[str | None], bytes] = ascii_lower) -> DataFrame:
    """Stored rows (part, row, doc_id, digest), in each part sorted by digest.

    ``part`` numbers the parts of the input and ``row`` the rows, so that repeated rows differ.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def compute(texts: list[str | None]) -> dict:
        return {"digest": [hashlib.sha256(normal(t)).digest() for t in texts]}

    found = map_texts(rows, ["doc_id"], "text", "digest binary", compute)
    numbered = found.select(F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("row"), "doc_id", "digest")
    return durable(numbered.sortWithinPartitions("digest", "row"))


def combine(entries: np.ndarray, largest: bool) -> np.ndarray:
    """One entry per digest, sorted: the counts added up, and the id that stays with its first row; null ids lose."""
    if not len(entries):
        return entries
    e = entries[np.argsort(entries["digest"], kind="stable")]  # merges what is sorted in parts
    first = np.concatenate([[True], e["digest"][1:] != e["digest"][:-1]])
    at, group = np.flatnonzero(first), np.cumsum(first) - 1
    if len(at) == len(e):
        return e
    out = e[at]
    out["n"] = np.add.reduceat(e["n"], at)
    out["none"] = np.logical_and.reduceat(e["none"], at)
    pick, never = (np.maximum, np.iinfo("int64").min) if largest else (np.minimum, np.iinfo("int64").max)
    out["id"] = pick.reduceat(np.where(e["none"], never, e["id"]), at)
    stays = (e["none"] == out["none"][group]) & ((e["id"] == out["id"][group]) | e["none"])
    out["row"] = np.minimum.reduceat(np.where(stays, e["row"], np.iinfo("int64").max), at)
    return out


def digit(values: np.ndarray, round: int) -> np.ndarray:
    """The digit of each digest that decides in a round, from the front of it."""
    front = np.frombuffer(values["digest"].astype("S32").tobytes(), ">u8")[::4].astype("uint64")
    return (front >> np.uint64(64 - FAN * (round + 1))) & np.uint64(2**FAN - 1)


def blocks(entries: np.ndarray, slot: int, round: int | None) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted entries of a part as rows of the parts that take them in a round; all stay where they are if it is None."""
    cuts = [0, len(entries)]
    to = np.full(len(entries), slot, "int64")
    if round is not None and len(entries):
        place = FAN * round
        to = (slot & ~((2**FAN - 1) << place)) | (digit(entries, round).astype("int64") << place)
        cuts = [0, *(np.flatnonzero(np.diff(to)) + 1), len(entries)]
    for a, b in zip(cuts, cuts[1:]):
        for i in range(a, b, BLOCK):
            piece = entries[i : min(i + BLOCK, b)]
            yield int(to[i]), piece[:1].tobytes()[:32], piece.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["slot", "low", "entries"]
    )


def first_runs(rows: DataFrame, largest: bool) -> DataFrame:
    """Blocks of the runs of all parts, dealt out for round 0. Rows come sorted as ``digests`` stores them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = -1, np.empty(0, ENTRY)
        for batch in batches:
            e = np.zeros(batch.num_rows, ENTRY)
            ids = batch.column("doc_id")
            e["digest"] = batch.column("digest").to_pylist()
            e["none"], e["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            e["row"], e["n"] = batch.column("row").to_numpy(), 1
            part = batch.column("part").to_numpy()
            # a new part begins a new run, and so does the next piece of a file
            new = np.flatnonzero((np.diff(part) != 0) | (e["digest"][1:] < e["digest"][:-1])) + 1
            for a, b in zip([0, *new], [*new, len(e)]):
                if a == b:
                    continue
                if slot != part[a] or len(held) and e["digest"][a] < held["digest"][-1]:
                    yield _batch(list(blocks(held, slot, 0)))
                    slot, held = int(part[a]), np.empty(0, ENTRY)
                held = combine(np.concatenate([held, e[a:b]]), largest)
                if len(held) > HELD:  # the last digest may go on
                    yield _batch(list(blocks(held[:-1], slot, 0)))
                    held = held[-1:]
        yield _batch(list(blocks(held, slot, 0)))

    return rows.select("part", "row", "doc_id", "digest").mapInArrow(run, BLOCKS)


def merged(dealt: DataFrame, largest: bool, next_round: int | None) -> DataFrame:
    """The runs that a part was dealt as one run, dealt out for the next round.

    Blocks come in the order of their first digests. What is smaller than the next block's first is
    merged and done with, so a merge holds the overlapping blocks of its runs and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, size = -1, [], 0

        def done(low: bytes | None) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size
            all_held = combine(np.concatenate(parts), largest)
            upto = len(all_held) if low is None else int(np.searchsorted(all_held["digest"], np.array(low, "S32")))
            yield _batch(list(blocks(all_held[:upto], slot, next_round)))
            parts = [all_held[upto:]]
            size = len(parts[0])

        for batch in batches:
            for at, low, entries in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != slot:
                    if size:
                        yield from done(None)
                    slot, parts, size, limit = at, [], 0, HELD
                elif size > limit:
                    yield from done(low)
                    limit = 2 * size + HELD  # many runs may overlap: wait until as much has come again
                parts.append(np.frombuffer(entries, ENTRY))
                size += len(parts[-1])
        if size:
            yield from done(None)

    return dealt.repartition("slot").sortWithinPartitions("slot", "low").mapInArrow(run, BLOCKS)


def tree_merge(rows: DataFrame, largest: bool = False) -> DataFrame:
    """(digest, keep_id, keep_row, n): one row per digest of the rows that ``digests`` stores.

    The row with the smallest (``largest``: largest) id stays; of rows with that id the first one.
    Every round is stored in the shared folder.
    """
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    rounds = max(1, -(-(parts - 1).bit_length() // FAN))
    now = durable(first_runs(rows, largest))
    for r in range(rounds):
        now = durable(merged(now, largest, r + 1 if r + 1 < rounds else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries in batch.column("entries").to_pylist():
                e = np.frombuffer(entries, ENTRY)
                digest = pa.Array.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(e["digest"].astype("S32").tobytes())]).cast(pa.binary())
                keep = pa.array(e["id"], pa.int64(), mask=e["none"])
                yield pa.RecordBatch.from_arrays([digest, keep, pa.array(e["row"]), pa.array(e["n"])], ["digest", "keep_id", "keep_row", "n"])

    return now.select("entries").mapInArrow(run, "digest binary, keep_id long, keep_row long, n long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = False, normal: Callable[[str | None], bytes] = ascii_lower) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Equal are texts whose ``normal`` forms have one digest; null counts as empty. One row of each
    group is kept: that with the smallest (``largest``: largest) id, null only if there is no
    other; of repeated rows with that id the first one stored.
    """
    rows = digests(docs, doc_id, text, normal)
    several = durable(tree_merge(rows, largest).where("n > 1"))
    # a digest of a third of the rows is one row per part here, and one part's rows in the last join
    present = rows.select("part", "digest").distinct()
    known = present.join(several, "digest")
    out = rows.join(known, ["part", "digest"], "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        _hex("digest").alias("text_sha256"),
    )


def _hex(digest: str) -> Column:
    return F.lower(F.hex(digest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), largest=True)


SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
