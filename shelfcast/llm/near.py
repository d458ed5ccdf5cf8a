"""Links between texts that share most of their five-word shingles.

Two texts link when the Jaccard similarity of their sets of shingles is ``SIMILAR`` or more. MinHash
bands find candidates: a pair at the limit shares one of 24 bands of 5 with a probability of 0.9999.
All that meet in a band's bucket are compared by their whole sets, but for pairs that other links
join already: first each text with the smallest and the largest of its buckets, which settles groups
of near copies in one row per member; then, in buckets that still hold several classes, blocks of
members with blocks of members. Blocks give stars, so no group gives more rows than it has members,
and a set travels once per block it meets. A crowd that is alike without being linked costs its
square, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.runtime import durable
from . import simhash_ball
from .common import components, map_texts, whole_groups, words_of

SHINGLE = 5
SIMILAR = 0.8
BANDS = 24
ROWS = 5
#: Members that a block holds on average.
BLOCK = 512
#: Shingles that are compared at once.
COLUMNS = 4096
MIX = np.uint64(0xFF51AFD7ED558CCD)
SHIFT = np.uint64(32)


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct shingles; all words are one shingle where they are fewer than ``length``."""
    from xxhash import xxh64_intdigest as digest

    words = words_of(text)
    if not words:
        return np.empty(0, "uint64")
    w = np.array([digest(x) for x in words], "uint64")
    k = min(length, len(w))
    h = np.zeros(len(w) - k + 1, "uint64")
    for j in range(k):
        h = (h ^ w[j : len(w) - k + 1 + j]) * MIX
        h ^= h >> SHIFT
    return np.unique(h)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, BANDS * ROWS, "uint64") * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, BANDS * ROWS, "uint64")


def bands(found: np.ndarray) -> np.ndarray:
    """A hash per band of the smallest permuted shingles; none for a text without words."""
    if not len(found):
        return np.empty(0, "int64")
    times, plus = _permutations()
    least = np.full(len(times), 2**64 - 1, "uint64")
    for at in range(0, len(found), 1 << 12):
        least = np.minimum(least, (found[at : at + (1 << 12), None] * times + plus).min(axis=0))
    h = np.arange(1, BANDS + 1, dtype="uint64")
    for column in least.reshape(BANDS, ROWS).T:
        h = (h ^ column) * MIX
        h ^= h >> SHIFT
    return h.view("int64")


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.empty(0, "int64"), *values]), pa.int64()))


def describe(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, the SimHash fingerprint fp and the bands of each text, from one pass over the texts."""

    def compute(texts: list[str | None]) -> dict:
        return {"fp": [simhash_ball.signed(simhash_ball.fingerprint(t)) for t in texts], "bands": _lists([bands(shingles(t)) for t in texts])}

    return map_texts(docs, keep, text, "fp long, bands array<long>", compute)


def shingle_sets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``set``: hashes of the distinct shingles."""
    return map_texts(docs, keep, text, "set array<long>", lambda texts: {"set": _lists([shingles(t).view("int64") for t in texts])})


def compare(nodes: np.ndarray, side: np.ndarray, two: bool, values: np.ndarray, offsets: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its star) for the members of a block that link, all with all or side 0 with side 1."""
    sizes = np.diff(offsets)
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(nodes)),) * 2
    distinct, at = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    # only shingles that several members have can be in an intersection
    often = np.bincount(at, minlength=len(distinct)) > 1
    column = np.cumsum(often) - 1
    kept = often[at]
    at, owner = column[at[kept]], owner[kept]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(a), len(b)))
    for begin in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
        has = np.zeros((len(nodes), min(COLUMNS, int(often.sum()) - begin)), "float32")
        has[owner[lo:hi], at[lo:hi] - begin] = 1
        both += has[a] @ has[b].T
    linked = both >= similar * (sizes[a][:, None] + sizes[b][None] - both)
    i, j = np.nonzero(linked if two else np.triu(linked, 1))
    i, j = a[i], b[j]
    star = nodes.copy()
    while True:  # the smallest node spreads along links
        before = star.copy()
        np.minimum.at(star, i, star[j])
        np.minimum.at(star, j, star[i])
        if (star == before).all():
            break
    some = np.flatnonzero(star != nodes)
    return nodes[some], star[some]


UNIT = ["key", "kind", "x", "y"]


def verified(placed: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Stored edges (a, b) of the blocks (key, kind, x, y) in which nodes were placed on side 0 or 1."""
    full = placed.join(sets, "node").repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, UNIT):
            found: list[tuple] = [(np.empty(0, "int64"),) * 2]
            sets = t["set"].chunk(0)
            offsets = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))]).astype("int64")
            values = sets.flatten().to_numpy(zero_copy_only=False)
            kind, x, y, side, node = (t[c].to_numpy() for c in ("kind", "x", "y", "side", "node"))
            cuts = np.flatnonzero(np.any([np.diff(t[c].to_numpy()) != 0 for c in UNIT], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(node)]):
                if b - a > 1:
                    two = bool(kind[a] == 1 or x[a] != y[a])
                    found.append(compare(node[a:b], side[a:b], two, values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], similar))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    return durable(full.select(*UNIT, "side", "node", "set").mapInArrow(run, "a long, b long").distinct())


def links(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similar: float = SIMILAR) -> DataFrame:
    """Edges (a, b) that connect what links of at least ``similar`` connect, among distinct texts.

    ``texts`` has one row (node, bands) per text; ``sets_of`` gives (node, set), one row per text, for
    a frame of nodes. Texts without words have no band and no link.
    """
    each = durable(texts.select("node", F.explode("bands").alias("band")))
    ends = each.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("size > 1")
    met = durable(each.join(ends, "band"))
    sets = durable(sets_of(met.select("node").distinct()))

    # every member with both ends of its bucket; a hub meets its members in blocks
    hubs = met.select("node", F.explode(F.array("low", F.when(F.col("node") != F.col("low"), F.col("high")))).alias("key"))
    hubs = durable(hubs.where("key <> node").distinct())
    many = hubs.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    unit = lambda kind, x, y: [F.lit(kind).alias("kind"), x.alias("x"), y.alias("y")]
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = hubs.join(many, "key").select("key", *unit(1, F.lit(0), block), F.lit(1).alias("side"), "node")
    centres = many.select("key", *unit(1, F.lit(0), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), F.lit(0).alias("side"), F.col("key").alias("node"))
    first = verified(members.unionByName(centres), sets, similar)

    # buckets of four and more that still hold several classes: their largest class is not compared with itself
    root = components(first)
    known = durable(met.where("size > 3").select("band", "node").join(root, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    per = known.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("k"))
    mixed = mixed.where("k > 1").select(
        "band", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rests")
    )
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    place = lambda kind, x, y, side: F.struct(*unit(kind, x, y), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest = F.concat(
        F.transform(upto("rests"), lambda y: place(0, F.least("own", y), F.greatest("own", y), F.col("own") > y)),
        F.transform(upto("mains"), lambda y: place(1, F.col("own"), y, F.lit(0))),
    )
    main = F.transform(upto("rests"), lambda x: place(1, x, F.col("own"), F.lit(1)))
    placed = known.join(mixed, "band").withColumn("own", own).select(F.col("band").alias("key"), "node", F.explode(F.when(is_main, main).otherwise(rest)).alias("p"))
    second = verified(placed.select("key", "p.*", "node"), sets, similar)
    return durable(first.unionByName(second).distinct())
