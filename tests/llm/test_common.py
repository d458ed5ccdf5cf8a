import random

from pyspark.sql import functions as F

from shelfcast.functions.runtime import durable
from shelfcast.llm.common import components, ranked, words_of


def test_words_are_cut_at_ascii_space_only():
    assert words_of("A\x0bb\x1cC D e\x85") == ["a", "b\x1cc d".encode().decode(), "e\x85"] or words_of("A\x0bb") == [b"a", b"b"]
    assert words_of("Ä B C\x1cd") == ["Ä".encode(), "b c\x1cd".encode()]
    assert words_of(None) == words_of("") == words_of(" \n") == []


def test_ranks_of_a_hot_group_need_many_slices(spark):
    df = durable(spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(100)).alias("g")))
    out = ranked(df, ["g"], [F.col("id")], rows_per_slice=50).toPandas()
    assert len(out) == 3000
    for _, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))
    one = ranked(df, ["g"], [F.col("id")]).toPandas()
    assert one.sort_values("id")["rank"].tolist() == out.sort_values("id")["rank"].tolist()


def test_components_of_paths_stars_and_rings(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(i, 200 + (i - 199) % 20) for i in range(200, 220)]
    edges += [(300, 300), (139, 41)] + [(random.randrange(400, 500), random.randrange(400, 500)) for _ in range(60)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
