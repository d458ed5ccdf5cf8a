"""Ranked lexical search through hashed max-sketches.

``index`` reads the documents once. Of each it stores the number of terms, the distinct terms with
their occurrences, and a sketch: a byte per coordinate, the largest number of occurrences among the
terms that hash there (255 stands for all from 255 on), in two rows of coordinates with hashes of their own, of
which the lesser counts. A term's impact grows with its occurrences and depends else on the lengths
of documents only, so the sketch bounds the impact of any term in a document from above, whatever
the corpus statistics are when a query comes.

``search`` takes queries in blocks. For a block it counts the documents that hold its terms, then
looks up the coordinates of all its terms in the sketches of some hundred documents at once and adds
up weight times largest impact: an upper bound of every score. Each task then scores its documents
exactly in the order of falling bounds, until the bound is under the last score that it keeps.
Documents are read where they lie; what is shuffled is the best few of each task.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.runtime import bounded_rows, durable
from .common import map_texts, table

TOP = 10
#: Coordinates of a row per distinct term, at least; always a power of two.
SPARSE = 4
#: Queries of a block: each block reads the index once.
QUERIES = 1000
#: Bounds that are worked out at once, times terms.
CELLS = 1 << 20
FULL = 255
#: Letters, digits and what is not ASCII make terms; A-Z in lower case.
CUT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Largest impact of a term without its weight.
MOST = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(CUT).split()


def hashes(terms: list[bytes]) -> np.ndarray:
    """Two 32-bit hashes per term, one per row of a sketch."""
    from xxhash import xxh64_intdigest as digest

    return np.fromiter(map(digest, terms), "uint64", len(terms)).view("uint32").reshape(-1, 2).T


def places(hashed: np.ndarray, width: int) -> np.ndarray:
    """Coordinates of the terms in both rows, the second behind the first."""
    return (hashed & np.uint32(width - 1)) + np.array([[0], [width]], "uint32")


def sketch(terms: list[bytes], tfs: list[int]) -> bytes:
    """Largest occurrences per coordinate. The width follows from the number of distinct terms."""
    width = 1 << max(6, (SPARSE * len(terms) - 1).bit_length())
    out = np.zeros(2 * width, "uint8")
    np.maximum.at(out, places(hashes(terms), width).ravel(), np.tile(np.minimum(tfs, FULL).astype("uint8"), 2))
    return out.tobytes()


def impact(tf, m):
    """A term's part of a score without its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_part(n: int, rows: int, total: int) -> int:
    return 100 - 75 + 75 * n * rows // total


def weight(rows: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored rows (row, doc_id, n, terms, tfs, sketch), one per document that has a term."""

    def compute(texts: list[str | None]) -> dict:
        out: dict[str, list] = {c: [] for c in ("n", "terms", "tfs", "sketch")}
        for text in texts:
            found = Counter(terms_of(text))
            names, tfs = list(found), list(found.values())
            out["n"].append(sum(tfs))
            out["terms"].append(b" ".join(names))
            out["tfs"].append(tfs)
            out["sketch"].append(sketch(names, tfs) if names else b"")
        return out

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = map_texts(rows, ["doc_id"], "text", "n long, terms binary, tfs array<int>, sketch binary", compute)
    return durable(made.where("n > 0").withColumn("row", F.monotonically_increasing_id()))


def frequencies(indexed: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Of the given terms those that occur, with the number of documents that hold them."""
    shared = indexed.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n = shared.value, Counter()
        for batch in batches:
            for held in batch.column(0).to_pylist():
                n.update(asked.intersection(held.split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    counted = indexed.select("terms").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.collect()}


class Queries:
    """A block of queries: their distinct terms with weights, and per query the places and weights of its terms."""

    def __init__(self, asked: list[tuple[object, list[bytes]]], df: dict[bytes, int], rows: int, total: int):
        place = {t: i for i, t in enumerate(df)}
        self.rows, self.total, self.hashes = rows, total, hashes(list(df))
        self.ids, self.terms, flat, starts = [], [], [], []
        for item, terms in asked:
            known = [(t, place[t], c * weight(rows, df[t])) for t, c in Counter(terms).items() if t in df]
            if known:
                self.ids.append(item)
                self.terms.append([(t, w) for t, _, w in known])
                starts.append(len(flat))
                flat += known
        self.starts = np.array(starts, "int64")
        self.places, self.weights = (np.array([x[i] for x in flat], "int64") for i in (1, 2))

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, documents x queries, for sketches of one width."""
        first, second = places(self.hashes, sketches.shape[1] // 2)
        tf = np.minimum(sketches[:, first], sketches[:, second]).astype("int64")
        r, c = np.nonzero(tf)
        at = tf[r, c]
        tf[r, c] = np.where(at == FULL, MOST, impact(at, m[r]))
        return np.add.reduceat(tf[:, self.places] * self.weights, self.starts, axis=1)

    def score(self, query: int, tfs: dict[bytes, int], m: int) -> int:
        return sum(w * impact(tf, m) for t, w in self.terms[query] if (tf := tfs.get(t)))


class Best:
    """The best documents of each query so far, and what a bound must reach to matter."""

    def __init__(self, queries: Queries, top: int):
        self.q, self.top = queries, top
        self.kept: list[list[tuple]] = [[] for _ in queries.ids]
        self.least = np.ones(len(queries.ids), "int64")
        self.scored = 0

    def offer(self, bounds: np.ndarray, document) -> None:
        """``document(j)`` gives (doc_id, row, occurrences, length part) of row j of ``bounds``."""
        for i in np.flatnonzero((bounds >= self.least).any(axis=0)):
            column = bounds[:, i]
            near = np.flatnonzero(column >= self.least[i])
            for j in near[np.argsort(-column[near], kind="stable")]:
                if column[j] < self.least[i]:
                    break
                doc_id, row, tfs, m = document(j)
                score = self.q.score(i, tfs, m)
                self.scored += 1
                if score:
                    kept = self.kept[i]
                    # on equal score the smaller id comes first, null last
                    insort(kept, (-score, doc_id is None, doc_id or 0, row))
                    del kept[self.top :]
                    if len(kept) == self.top:
                        self.least[i] = -kept[-1][0]


def offer_batch(batch: pa.RecordBatch, q: Queries, best: Best) -> None:
    """Bounds of all documents of a batch, then exact scores by falling bounds. Rows of one sketch width go together."""
    ids, rows, n = (batch.column(c).to_pylist() for c in ("doc_id", "row", "n"))
    sketches, terms, tfs = (batch.column(c) for c in ("sketch", "terms", "tfs"))
    m = np.array([length_part(x, q.rows, q.total) for x in n], "int64")
    width = pc.binary_length(sketches).to_numpy()
    held: dict[int, tuple] = {}

    def of(j: int) -> tuple:
        if j not in held:
            held[j] = ids[j], rows[j], dict(zip(terms[j].as_py().split(), tfs[j].as_py())), int(m[j])
        return held[j]

    for size in np.unique(width):
        at = np.flatnonzero(width == size)
        step = max(1, CELLS // max(size, len(q.places), q.hashes.shape[1]))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            block = np.frombuffer(b"".join(sketches[int(j)].as_py() for j in some), "uint8").reshape(len(some), size)
            best.offer(q.bounds(block, m[some]), lambda j: of(int(some[j])))


def search_block(indexed: DataFrame, asked: list[tuple[object, list[bytes]]], rows: int, total: int, item_type: str, top: int) -> DataFrame:
    """(query, item_id, doc_id, row, score): the best of each task for the queries of a block."""
    df = frequencies(indexed, {t for _, terms in asked for t in terms})
    shared = indexed.sparkSession.sparkContext.broadcast(Queries(asked, df, rows, total))
    empty = indexed.sparkSession.createDataFrame([], f"query long, item_id {item_type}, doc_id long, row long, score long")
    if not shared.value.ids:
        return empty
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = Best(q, top)
        for batch in batches:
            offer_batch(batch, q, best)
        out = [(i, q.ids[i], None if none else doc, row, -less) for i, kept in enumerate(best.kept) for less, none, doc, row in kept]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema.names)

    return indexed.select("row", "doc_id", "n", "terms", "tfs", "sketch").mapInArrow(run, empty.schema)


def search(indexed: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest scores above 0 of each query.

    Equal scores are ranked by id, null last. Every row of the index is a document, repeated ones
    too. Queries that repeat id and text are one query; those with one id and other texts are ranked
    each on its own. Queries without a term that occurs have no row.
    """
    spark = items.sparkSession
    stats = indexed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    asked = durable(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).distinct())
    item_type = asked.schema["item_id"].dataType.simpleString()
    blocks = -(-asked.count() // QUERIES)
    found = spark.createDataFrame([], f"block int, query long, item_id {item_type}, doc_id long, row long, score long")
    for b in range(blocks if stats["rows"] else 0):
        part = bounded_rows(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), 4 * QUERIES, "queries of a block")
        some = search_block(indexed, [(r.item_id, terms_of(r.text)) for r in part], stats["rows"], stats["total"], item_type, top)
        found = found.unionByName(some.withColumn("block", F.lit(b)))
    order = W.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), len AS MATERIALIZED (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL
), corpus AS MATERIALIZED (
  SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM len
), weight AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * c + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, c
), asked AS MATERIALIZED (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * c) // l)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (doc_id), corpus
  GROUP BY item_id, tf.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
