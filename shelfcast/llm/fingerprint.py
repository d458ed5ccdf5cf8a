"""SimHash document fingerprints and a search by Hamming distance, in DataFrame functions only.

A term is a word in lower case; each of its occurrences votes with a weight that grows with its
length, since short words say little. Two 64-bit hashes of the term vote on 128 signed bits. The
votes of two bits share one sum: a bit of the hash and the one 32 places higher are counted in the
lower and the upper half of a long.

``within`` finds fingerprints by permuted block tables: 128 bits are four blocks, and fingerprints
that differ in at most 3 bits agree in at least one block, so a table per block holds all candidates.
``search`` does the same for any radius, with as many blocks as it takes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.runtime import durable
from .common import table

BITS = 128
RADIUS = 3
#: Stands for a null id among keys; ids are ordered with null last.
NO_ID = -(2**63)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, hash, text): rows with equal key and hash are repeated rows. A null text is empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.col(f"`{doc_id}`").cast("long")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(NO_ID)).alias("key"), F.xxhash64(body).alias("hash"), body.alias("text"))


def successors(docs: DataFrame) -> DataFrame:
    """(key, hash, n_chars, next_key, next_hash) of distinct keyed documents, stored.

    The next document has the next larger id (of equal ids, the next larger hash; null ids last), and
    the first one follows the last. Only keys move: range partitions are numbered inside, and the
    last row of one is followed by the first row of the next.
    """
    keys = docs.select("key", "hash", F.char_length("text").cast("long").alias("n_chars"), F.col("doc_id").isNull().alias("none")).distinct()
    order = [F.col("none"), F.col("key"), F.col("hash")]
    ranged = durable(keys.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    own = F.struct("none", "key", "hash")
    # one row per partition
    firsts = ranged.groupBy("slice").agg(F.min(own).alias("first"))
    along = W.orderBy("slice")
    firsts = firsts.select("slice", F.coalesce(F.lead("first").over(along), F.min("first").over(W.partitionBy())).alias("after"))
    inside = ranged.withColumn("then", F.lead(own).over(W.partitionBy("slice").orderBy(*order)))
    after = F.coalesce("then", "after")
    return durable(
        inside.join(firsts, "slice").select("key", "hash", "n_chars", after["key"].alias("next_key"), after["hash"].alias("next_hash"))
    )


def with_edits(docs: DataFrame, following: DataFrame) -> DataFrame:
    """Distinct keyed documents with n_chars, next_key, next_hash and edited text.

    Edited: the last floor(n_chars / 2) code points give way to the first as many of the next document.
    A text is shuffled once as itself, and its beginning once more to the document before it.
    """
    # one row per repeated row; this needs the same partitioning and order as the joins
    once = docs.withColumn("copy", F.row_number().over(W.partitionBy("key", "hash").orderBy("key", "hash"))).where("copy = 1").drop("copy")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    begun = (
        following.alias("f").join(once.alias("d"), (F.col("f.next_key") == F.col("d.key")) & (F.col("f.next_hash") == F.col("d.hash")))
        .select("f.key", "f.hash", "n_chars", "next_key", "next_hash", F.substring("d.text", F.lit(1), half).alias("beginning"))
    )
    return once.join(begun, ["key", "hash"]).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), "beginning")
    )


def votes(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """fp0, fp1: 128 bits of each text, by columns that name it. Without words all bits are 0.

    A bit is 1 if terms with more than half the weight have it. Sums of two bits share a long, so
    weights may add up to 2^32 (over a hundred million words); above that it is an error.
    """
    # split() gives at least one term; the empty ones, before the first word or of a text without words, weigh nothing
    term = texts.select(*by, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("term"))
    size = "least(char_length(term), 12)"
    hashed = term.selectExpr(*by, "xxhash64(term) AS h0", "xxhash64(term, 1) AS h1", f"CASE WHEN term = '' THEN 0L ELSE 1 + ({size} * {size}) DIV 4 END AS w")
    both = (1 << 32) | 1
    sums = [F.expr(f"sum((shiftrightunsigned(h{j}, {i}) & {both}L) * w) AS s{j}_{i}") for j in range(2) for i in range(32)]
    summed = hashed.groupBy(*by).agg(F.sum("w").alias("all"), *sums)

    def word(j: int) -> str:
        lower = " | ".join(f"shiftleft(CAST(2 * (s{j}_{i} & {(1 << 32) - 1}L) > all AS BIGINT), {i})" for i in range(32))
        upper = " | ".join(f"shiftleft(CAST(2 * shiftrightunsigned(s{j}_{i}, 32) > all AS BIGINT), {i + 32})" for i in range(32))
        return f"CASE WHEN all >= {1 << 32}L THEN CAST(raise_error('text too long for 32-bit votes') AS BIGINT) ELSE {lower} | {upper} END AS fp{j}"

    return summed.selectExpr(*by, word(0), word(1))


def distance(a: str, b: str) -> Column:
    """Differing bits of two fingerprints whose columns are a0, a1 and b0, b1."""
    return F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))


def _blocks(a: str, b: str) -> list[Column]:
    upper = lambda c: F.shiftrightunsigned(c, 32)
    lower = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return [upper(a), lower(a), upper(b), lower(b)]


def within(stored: DataFrame, queries: DataFrame, radius: int = RADIUS, per_list: int = 4096) -> DataFrame:
    """(fp0, fp1, n): for each distinct query fingerprint the rows of ``stored`` (fp0, fp1, n) within ``radius``.

    ``stored`` has one row per distinct fingerprint with its number of documents. A bucket of a table
    may hold any share of them, so it is kept as lists of a bounded length, and a query meets lists,
    not members. Up to 3 bits four blocks do, and a member that agrees in several counts in the first;
    a larger radius counts what ``search`` finds.
    """
    if radius > 3:
        found = search(stored.withColumn("id", F.monotonically_increasing_id()), queries, radius, per_list=per_list)
        return found.groupBy("fp0", "fp1").agg(F.sum("n").alias("n"))
    lists = -(-stored.count() // per_list) or 1
    member = F.struct("fp0", "fp1", "n")
    tables = (
        stored.select("fp0", "fp1", "n", F.posexplode(F.array(*_blocks("fp0", "fp1"))).alias("block", "value"))
        .groupBy("block", "value", F.pmod(F.xxhash64("fp0", "fp1"), F.lit(lists)).alias("list"))
        .agg(F.collect_list(member).alias("members"))
    )
    asked = queries.select("fp0", "fp1").distinct().select("fp0", "fp1", F.posexplode(F.array(*_blocks("fp0", "fp1"))).alias("block", "value"))
    near = "bit_count(m.fp0 ^ fp0) + bit_count(m.fp1 ^ fp1)"
    first = (
        "CASE block WHEN 0 THEN true WHEN 1 THEN shiftrightunsigned(m.fp0 ^ fp0, 32) <> 0 "
        "WHEN 2 THEN shiftrightunsigned(m.fp0 ^ fp0, 32) <> 0 AND ((m.fp0 ^ fp0) & 4294967295L) <> 0 "
        "ELSE shiftrightunsigned(m.fp0 ^ fp0, 32) <> 0 AND ((m.fp0 ^ fp0) & 4294967295L) <> 0 AND shiftrightunsigned(m.fp1 ^ fp1, 32) <> 0 END"
    )
    counted = F.expr(f"aggregate(members, 0L, (s, m) -> s + CASE WHEN {near} <= {radius} AND {first} THEN m.n ELSE 0L END)")
    return asked.join(tables, ["block", "value"]).groupBy("fp0", "fp1").agg(F.sum(counted).alias("n"))


def _masks(radius: int, keep: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(the bits of each of radius + keep blocks as masks of fp0 and fp1, all choices of ``keep`` blocks)."""
    blocks = radius + keep
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = []
    for a, b in zip(cuts, cuts[1:]):
        bits = ((1 << (b - a)) - 1) << a
        masks.append((signed(bits & ((1 << 64) - 1)), signed(bits >> 64)))
    return masks, list(combinations(range(blocks), keep))


def search(stored: DataFrame, queries: DataFrame, radius: int, keep: int = 2, per_list: int = 4096, id: str = "id") -> DataFrame:
    """(fp0, fp1, found_id, n, distance): for each distinct query fingerprint all of ``stored`` (id, fp0, fp1, n) within any ``radius``.

    Fingerprints are cut into radius + ``keep`` blocks, of which two within the radius have ``keep``
    alike, so there is a table for each choice of so many blocks. More blocks kept alike make more
    tables and shorter lists. A pair is found in the table of the first blocks that it has alike. Rows
    are pairs of distinct fingerprints; the documents of a fingerprint follow from it.
    """
    masks, choices = _masks(radius, keep)
    # in two's complement the masks of several blocks add up by "or" like those of one
    tables = [(i, *(reduce(int.__or__, (masks[b][j] for b in c)) for j in range(2))) for i, c in enumerate(choices)]
    rows = ", ".join(f"named_struct('c', {c}, 'm0', {_long(m0)}, 'm1', {_long(m1)})" for c, m0, m1 in tables)
    posted = f"inline(transform(array({rows}), t -> named_struct('c', t.c, 'k0', fp0 & t.m0, 'k1', fp1 & t.m1)))"
    lists = -(-stored.count() // per_list) or 1
    named = stored.select(F.col(f"`{id}`").alias("id"), "fp0", "fp1", "n")
    member = F.struct("id", "fp0", "fp1", "n")
    kept = (
        named.selectExpr("id", "fp0", "fp1", "n", posted)
        .groupBy("c", "k0", "k1", F.pmod(F.xxhash64("fp0", "fp1"), F.lit(lists)).alias("list"))
        .agg(F.collect_list(member).alias("members"))
    )
    asked = queries.select("fp0", "fp1").distinct().selectExpr("fp0", "fp1", posted)
    bits = ", ".join(f"named_struct('m0', {_long(a)}, 'm1', {_long(b)})" for a, b in masks)
    alike = f"filter(transform(array({bits}), (b, i) -> IF(((m.fp0 ^ fp0) & b.m0) = 0 AND ((m.fp1 ^ fp1) & b.m1) = 0, i, -1)), i -> i >= 0)"
    chosen = ", ".join(f"array({', '.join(map(str, c))})" for c in choices)
    near = "bit_count(m.fp0 ^ fp0) + bit_count(m.fp1 ^ fp1)"
    found = f"filter(members, m -> {near} <= {radius} AND slice({alike}, 1, {keep}) = element_at(array({chosen}), c + 1))"
    met = asked.join(kept, ["c", "k0", "k1"]).selectExpr("fp0", "fp1", f"explode({found}) AS m")
    return met.selectExpr("fp0", "fp1", "m.id AS found_id", "m.n AS n", f"CAST({near} AS INT) AS distance")


def _long(x: int) -> str:
    # the least long has no literal
    return f"{x}L" if x > -(1 << 63) else f"({x + 1}L - 1L)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edits; n_within: other documents within RADIUS, for ids divisible by 20."""
    docs = keyed(table(spark, sf_dir, "documents"))
    edits = with_edits(docs, successors(docs))
    sides = edits.select(
        "key", "hash", "n_chars", "next_key", "next_hash", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("side", "body"),
    )
    names = ["key", "hash", "n_chars", "next_key", "next_hash", "edited_sha256"]
    both = votes(sides, [*names, "side"], "body").groupBy(*names)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    found = durable(both.agg(of(0, "fp0").alias("fp0"), of(0, "fp1").alias("fp1"), of(1, "fp0").alias("e0"), of(1, "fp1").alias("e1")))
    after = found.select(F.col("key").alias("next_key"), F.col("hash").alias("next_hash"), F.col("fp0").alias("n0"), F.col("fp1").alias("n1"))
    rows = docs.select("doc_id", "key", "hash").groupBy("doc_id", "key", "hash").agg(F.count("*").alias("copies"))
    rows = durable(rows.join(found, ["key", "hash"]))
    stored = durable(rows.groupBy("fp0", "fp1").agg(F.sum("copies").alias("n")))
    asked = within(stored, rows.where("doc_id % 20 = 0"))
    asked = asked.withColumnRenamed("n", "reached")
    text = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    likeness = lambda d: 1 - d / F.lit(float(BITS))
    return (
        rows.join(after, ["next_key", "next_hash"]).join(asked, ["fp0", "fp1"], "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id", "n_chars", "edited_sha256", text("fp0", "fp1").alias("fingerprint"), text("e0", "e1").alias("edited_fingerprint"),
            likeness(distance("fp", "e")).alias("near_edited"), likeness(distance("fp", "n")).alias("near_next"),
            F.when(F.col("doc_id") % 20 == 0, F.col("reached") - 1).alias("n_within"),
        )
    )
