"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has many points on a ring of hashes. A row belongs to the first point at or after its
own hash; all rows before the same point are one arc and share one order of shards. A shard takes
the rows of its own arcs, in ring order, until it is full; the others go on clockwise and take the
first shard with room. Which rows of an arc go on depends on their position in the arc only.

The rows of an arc are counted by Spark; the walk round the ring works on those counts (shards ×
points numbers, whatever the data) on the driver; and each row finds its shard and slot from its arc
and its position in it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.runtime import durable
from .common import ranked, table


def ring(shards: int, points: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owners) of the virtual nodes, sorted by position. They depend on the shard's number only."""
    name = lambda s, v: hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8]
    found = sorted((int.from_bytes(name(s, v), "big", signed=True), s) for s in range(shards) for v in range(points))
    return np.array([p for p, _ in found], "int64"), np.array([s for _, s in found], "int64")


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Most rows per shard. Without slack they add up to all rows, so counts differ by one at most."""
    if slack:
        return np.full(shards, int(np.ceil(rows * (1 + slack) / shards)))
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)])


def walk(counts: np.ndarray, owners: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Where the rows of each arc go: (arc, first position, shard, slot of that position).

    ``counts`` are rows per arc, ``most`` the capacities. A piece holds until the next one of its arc.
    """
    room, filled = most.astype("int64").copy(), np.zeros(len(most), "int64")
    pieces, waiting = [], {}

    def place(arc: int, start: int, n: int, shard: int) -> int:
        taken = int(min(n, room[shard]))
        if taken:
            pieces.append((arc, start, int(shard), int(filled[shard])))
            room[shard] -= taken
            filled[shard] += taken
        return taken

    for arc, n in enumerate(counts):  # each shard's own arcs first
        taken = place(arc, 0, int(n), owners[arc])
        if taken < n:
            waiting[arc] = [(arc, taken, int(n) - taken)]
    carried: list[tuple[int, int, int]] = []
    for turn in range(2):  # after a second round every piece has passed every shard
        for arc, shard in enumerate(owners):
            left = []
            for home, start, n in carried:
                taken = place(home, start, n, shard)
                if taken < n:
                    left.append((home, start + taken, n - taken))
            carried = left + (waiting.pop(arc, []) if turn == 0 else [])
    if carried:
        raise ValueError("the shards have less room than there are rows")
    return sorted(pieces)


def assign(rows: DataFrame, key: list[str], shards: int, points: int = 128, slack: float = 0.0) -> DataFrame:
    """Add shard and slot to every row. ``rows`` is read several times and must be stored.

    Null keys are keys like others; rows with equal keys share an arc. The last ``key`` columns only
    order the rows of an arc if the first one, which sets the place on the ring, is equal.
    """
    positions, owners = ring(shards, points)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(positions, h.to_numpy(), "left") % len(positions)).astype("int32"))

    placed = rows.withColumn("_arc", arc_of(F.xxhash64(F.col(key[0]))))
    found = placed.groupBy("_arc").count().collect()  # one row per virtual node at most
    counts = np.zeros(len(owners), "int64")
    for r in found:
        counts[r["_arc"]] = r["count"]
    pieces = walk(counts, owners, capacities(int(counts.sum()), shards, slack))
    starts = np.array([(arc << 44) | start for arc, start, _, _ in pieces], "int64")
    froms, shard_of, slot_of = (np.array([p[i] for p in pieces], "int64") for i in (1, 2, 3))

    @F.pandas_udf("shard int, slot long")
    def place_of(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        i = np.searchsorted(starts, (arc.to_numpy("int64") << 44) | rank.to_numpy("int64"), "right") - 1
        return pd.DataFrame({"shard": shard_of[i].astype("int32"), "slot": slot_of[i] + rank.to_numpy("int64") - froms[i]})

    numbered = ranked(placed, ["_arc"], [F.col(c) for c in key], "_rank")
    return numbered.withColumn("_at", place_of("_arc", "_rank")).select(*rows.columns, "_at.shard", "_at.slot")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32). A null text has size 16 and checksum 0."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards, law ``rows``: bounded loads without slack fill every shard to one row of the mean."""
    rows = durable(sizes(table(spark, sf_dir, "documents")))
    out = assign(rows, ["doc_id", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
