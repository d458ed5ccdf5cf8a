"""SimHash near-duplicates by meeting in the middle.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. A difference of up to 3 bits has a
middle that is 2 flips from one fingerprint and 1 flip from the other. By parity only one side has
to make the larger ball: fingerprints with an even number of ones emit themselves and all words 2
flips away, odd ones all words 1 flip away, so all emitted words are even. Whatever meets at a word
with a fingerprint that is at most 1 flip away is linked to that one, so a star round it replaces
the pairs, and thousands of near copies give no more rows than their balls.

A ball has about a thousand words, so fingerprints without any neighbour are set aside first: each
half of the word is joined, in all variants with at most 1 flip, to the halves that occur. Of 3
differing bits one half has at most 1, so no link is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runtime import durable
from .common import components, map_texts, table, words_of

RADIUS = 3
SEED = 42
SHINGLE = 3


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits of a whole text: a bit is 1 if it is in more than half the shingle hashes; 0 without words."""
    from xxhash import xxh64_intdigest as digest

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    lasts = ends[shingle - 1 :] or ends[-1:]
    votes = np.zeros(64, "int64")
    for at in range(0, len(lasts), 1 << 16):
        part = [digest(joined[a : b - 1], seed) for a, b in zip(starts[at:], lasts[at : at + (1 << 16)])]
        votes += np.unpackbits(np.array(part, ">u8").view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(votes * 2 > len(lasts)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and fp, a signed 64-bit number. Texts are read where they lie; null is empty."""
    return map_texts(docs, keep, text, "fp long", lambda texts: {"fp": [signed(fingerprint(t)) for t in texts]})


def _flips(bits: int, n: int) -> list[int]:
    return [signed(sum(1 << b for b in chosen)) for chosen in combinations(range(bits), n)]


def with_neighbours(fps: DataFrame) -> DataFrame:
    """Of the distinct values ``fp`` those with another one whose upper or lower half differs in at most one bit."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))  # a mark tells the halves apart
    halves = fps.select("fp", F.explode(F.array(low, high)).alias("half"))
    present = halves.groupBy(F.col("half").alias("at")).agg(F.count("*").alias("n"))
    tried = halves.select("fp", "half", F.explode(F.lit([0, *_flips(32, 1)])).alias("flip"))
    tried = tried.select("fp", F.col("half").bitwiseXOR(F.col("flip")).alias("at"), (F.col("flip") == 0).alias("own"))
    # Spark sizes the 66 variants of a fingerprint as if they were a few rows, and would send them to the driver to broadcast them
    return tried.join(present.hint("merge"), "at").where("NOT own OR n > 1").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b) among distinct values ``fp``: stars that connect whatever links at 3 or fewer bits connect."""
    # a fingerprint becomes up to 2017 rows, so tasks must not be cut by the size of their input
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() // 2000)
    fps = fps.repartition(tasks, "fp")
    even = F.bit_count("fp") % 2 == 0
    ball = F.when(even, F.lit([0, *_flips(64, 2)])).otherwise(F.lit(_flips(64, 1)))
    met = fps.select("fp", F.explode(ball).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "fp", (F.bit_count("flip") < 2).alias("close")
    )
    # at most 2081 words lie within 2 flips of a middle, so these lists are bounded; most have one
    # fingerprint, so there is nothing to aggregate before the shuffle
    met = met.repartition("middle").groupBy("middle").agg(F.collect_list("fp").alias("all"), F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"))
    stars = met.where("hub IS NOT NULL AND size(all) > 1").select(F.col("hub").alias("a"), F.explode("all").alias("b"))
    return stars.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def roots(found: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) of the distinct fingerprints of stored rows: the smallest fingerprint that links, ``more`` (a, b) among them, reach."""
    distinct = durable(found.select("fp").distinct())
    near = links(durable(with_neighbours(distinct)))
    linked = components(near if more is None else near.unionByName(more)).select(F.col("node").alias("fp"), "root")
    return distinct.join(durable(linked), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fp, component_id) for stored rows with ``doc_id`` and ``fp``.

    component_id is the smallest doc_id that links reach, ids that are null left out; it is null
    where a class has no other.
    """
    least = found.groupBy("fp").agg(F.min(doc_id).alias("least"))
    known = durable(least.join(roots(found), "fp"))
    of = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(of, "root").select("fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = durable(fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]))
    return found.join(classes(found), "fp").select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
