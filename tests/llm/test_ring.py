import numpy as np
import pandas as pd

from shelfcast.functions.runtime import durable
from shelfcast.llm import ring

from .edge import ROWS, frame


def one_by_one(counts, owners, most):
    """The same walk, a row at a time."""
    room, out, waiting = list(most), {}, []
    for arc, n in enumerate(counts):
        for rank in range(n):
            if room[owners[arc]]:
                room[owners[arc]] -= 1
                out[arc, rank] = owners[arc]
            else:
                waiting.append((arc, rank))
    queue = []
    for turn in range(2):
        for point in range(len(owners)):
            left = []
            for w in queue:
                if room[owners[point]]:
                    room[owners[point]] -= 1
                    out[w] = owners[point]
                else:
                    left.append(w)
            queue = left + ([w for w in waiting if w[0] == point] if turn == 0 else [])
    assert not queue
    return out


def test_walk_is_that_of_single_rows():
    rng = np.random.default_rng(5)
    for shards, points in ((3, 4), (5, 8), (1, 3)):
        _, owners = ring.ring(shards, points)
        counts = rng.integers(0, 12, len(owners))
        most = ring.capacities(int(counts.sum()), shards)
        want = one_by_one(counts, owners, most)
        pieces = ring.walk(counts, owners, most)
        got, slots = {}, {s: set() for s in range(shards)}
        for i, (arc, start, shard, slot) in enumerate(pieces):
            end = pieces[i + 1][1] if i + 1 < len(pieces) and pieces[i + 1][0] == arc else counts[arc]
            for rank in range(start, end):
                got[arc, rank] = shard
                slots[shard].add(slot + rank - start)
        assert got == want
        assert all(s == set(range(most[k])) for k, s in slots.items())


def test_counts_differ_by_one_and_slots_have_no_gap(spark):
    rows = durable(ring.sizes(spark.range(1003).selectExpr("id AS doc_id", "repeat('é', CAST(id % 5 AS INT)) AS text")))
    out = ring.assign(rows, ["doc_id", "text_crc32"], 40).toPandas()
    per = out.groupby("shard")["slot"]
    assert len(out) == 1003 and len(per) == 40 and per.size().max() - per.size().min() <= 1
    assert (per.max() + 1 == per.size()).all() and (per.nunique() == per.size()).all()
    again = ring.assign(rows, ["doc_id", "text_crc32"], 40).toPandas()
    pd.testing.assert_frame_equal(out.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))


def test_few_rows_move_with_slack(spark):
    rows = durable(ring.sizes(spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")))
    a = ring.assign(rows, ["doc_id"], 10, slack=0.25).toPandas().set_index("doc_id")["shard"]
    b = ring.assign(rows, ["doc_id"], 11, slack=0.25).toPandas().set_index("doc_id")["shard"]
    assert a.value_counts().max() <= 500
    # a plain modulus moves ten of eleven
    assert (a != b.reindex(a.index)).mean() < 0.35


def test_edges(spark):
    rows = durable(ring.sizes(frame(spark)))
    out = ring.assign(rows, ["doc_id", "text_crc32"], 4).toPandas()
    assert len(out) == len(ROWS)
    assert sorted(out.groupby("shard").size()) == [4, 4, 4, 4]
    assert out[out.doc_id == 3]["size"].item() == 16 and out[out.doc_id == 3].text_crc32.item() == 0
    empty = durable(ring.sizes(frame(spark, [])))
    assert ring.assign(empty, ["doc_id", "text_crc32"], 4).count() == 0
