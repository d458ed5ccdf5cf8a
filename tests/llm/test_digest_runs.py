import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import digest_runs as dr

from .edge import LONG, ROWS, frame


def plain(rows, largest):
    """(id, kept id, size, digest) of every row, and the number of kept rows of each digest."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode().lower()].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(map(str, out)), len(groups)


def check(df, rows, largest):
    got = df.collect()
    want, n = plain(rows, largest)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == n == len({r.text_sha256 for r in got if r.kept})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_edges_and_both_ends(spark):
    rows = ROWS + [(50, "ONE two Three four fIve", "en", "a", 0), (51, LONG.upper(), "en", "a", 0), (52, "Ä b", "en", "a", 0), (53, "ä b", "en", "a", 0)]
    for largest in (False, True):
        check(dr.groups(frame(spark, rows), largest=largest), rows, largest)
    assert dr.groups(frame(spark, [])).count() == 0


def test_many_parts_and_a_hot_text(spark):
    rows = [(i, "hot Text" if i % 3 == 0 else f"text {i % 700}", "en", "a", 0) for i in range(3000)]
    for n in (1, 7, 8, 9, 70):
        check(dr.groups(frame(spark, rows).repartition(n), largest=True), rows, True)


def test_runs_longer_than_a_block(spark):
    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), F.col("id") % 390_000).alias("text")).repartition(9)
    got = dr.groups(docs).groupBy("group_size", (F.col("keep_id") == F.col("doc_id") % 390_000).alias("right"), "kept").count().collect()
    assert {(r.group_size, r.right, r.kept): r["count"] for r in got} == {(1, True, True): 380_000, (2, True, True): 10_000, (2, True, False): 10_000}


def test_a_part_holds_its_stretch_only(spark):
    rows = dr.digests(frame(spark, [(i, f"t{i}", "en", "a", 0) for i in range(2000)]).repartition(16))
    now = dr.first_runs(rows, False)
    for r in (0, 1):
        now = dr.merged(now, False, 1 - r or None if r == 0 else None)
    seen = 0
    for slot, entries in now.select("slot", "entries").collect():
        e = np.frombuffer(entries, dr.ENTRY)
        seen += len(e)
        assert (e["digest"][1:] > e["digest"][:-1]).all()
        for r in (0, 1):
            assert set(dr.digit(e, r)) == {slot >> (dr.FAN * r) & 7}
    assert seen == 2000


def test_digests_that_begin_alike_stay_apart():
    e = np.zeros(4, dr.ENTRY)
    e["digest"] = [b"a" * 31 + b"b", b"a" * 31 + b"a", b"a" * 31 + b"b", b"a" * 8 + b"\x00" * 24]
    e["id"], e["row"], e["n"] = [5, 6, 4, 1], [0, 1, 2, 3], 1
    out = dr.combine(e, False)
    assert out["n"].tolist() == [1, 1, 2] and out["id"].tolist() == [1, 6, 4] and out["row"].tolist() == [3, 1, 2]
