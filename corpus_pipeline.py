"""A corpus in four steps: language ID, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. Stages decide on all rows
that their predecessor kept, and on them alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions.runtime import durable
from shelfcast.llm import bpe, langid, mixing, near, simhash_ball


#: Stands for a null id among keys.
NO_ID = -(2**63)


def packed(docs: DataFrame) -> DataFrame:
    """Each document as one column ``row``, so that no column of it can clash with those of a stage."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models accept; lang becomes the language they find.

    Rejected are texts without letters and those far less like the chosen language than labelled
    texts that the models have not seen.
    """
    found = langid.identify(packed(docs), langid.fit(docs), ["row"], "row.text").where("NOT rejected")
    return found.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id, null last.

    Documents are linked by SimHash fingerprints within 3 bits, and by a similarity of 0.8 or more of
    their five-word shingles, which 64 bits cannot tell within so small a radius.
    Among rows with that id one stays, of several texts the one with the smallest hashes.
    """
    # plain keys without null, so that the join and the aggregate behind it share one shuffle of the texts
    text = F.coalesce("row.text", F.lit(""))
    hashes = {f"h{i}": F.xxhash64(text, F.lit(i)) for i in range(2)}
    rows = packed(docs).withColumns({"id": F.coalesce("row.doc_id", F.lit(NO_ID)), **hashes})
    key = ["id", "h0", "h1"]
    found = near.describe(rows.withColumn("text", F.col("row.text")), key)
    # rows of a text meet as one small row per text and task
    first = F.min(F.struct((F.col("id") == NO_ID).alias("none"), *key))
    texts = durable(found.groupBy("h0", "h1").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), first.alias("first")).withColumn("node", F.monotonically_increasing_id()))

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = texts.join(nodes, "node").select("node", "first.id", "h0", "h1")
        chosen = rows.select(*key, F.col("row.text").alias("text")).join(wanted, key)
        return near.shingle_sets(chosen, ["node"]).groupBy("node").agg(F.first("set").alias("set"))

    of = lambda side: texts.select(F.col("node").alias(side), F.col("fp").alias(f"{side}_fp"))
    links = near.links(texts.select("node", "bands"), sets).join(of("a"), "a").join(of("b"), "b").where("a_fp <> b_fp")
    similar = durable(links.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct())
    kept = texts.join(simhash_ball.roots(texts, similar), "fp").groupBy("root").agg(F.min("first").alias("k")).select("k.id", "k.h0", "k.h1")
    # repeated rows of a kept document are dropped where the join has brought them together
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: each source comes near its target share of words."""
    sized = docs.select("source", mixing.size_of("text").alias("size"), mixing.pick_order("doc_id", "text").alias("pick"))
    rows = packed(docs).withColumns({
        "source": F.col("row.source"), "size": mixing.size_of("row.text"), "pick": mixing.pick_order("row.doc_id", "row.text"),
    })
    taken = mixing.copies_of(rows, mixing.plan(durable(sized)), "source", "size", "pick").where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token counts and digests of every document."""
    return bpe.encode_documents(docs, *bpe.public_vocabulary(), ["doc_id", "lang", "source"])


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("source mix", mix), ("byte-level BPE", tokens)]

#: Models, XXH64 and byte-level BPE are beyond SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
