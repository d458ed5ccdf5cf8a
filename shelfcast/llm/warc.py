"""WARC archives without repeated payloads: revisit records are resolved by payload digest.

``captures`` describes pages, ``resolve`` shuffles the headers by payload digest and decides which
record keeps the payload, ``write_archives`` writes records with fresh headers, ``read_archives``
parses the files again and ``restore`` joins revisits to the responses they refer to.

The files come from Spark's text writer: a WARC record ends in two line ends, so that is the
separator of "lines", and files appear through Spark's commit protocol. They are compressed as a whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.runtime import scratch_path
from .common import table

RECORD_ID = "urn:shelfcast:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest). A null payload is empty."""
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )


def resolve(found: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Add record_type and refers_to.

    Of records with equal payloads of at least ``least_bytes`` the smallest page_id is the response.
    Repeated rows of that page are all responses, and so are all records of a digest that has only
    null ids; a record with null id is else a revisit. Headers only are aggregated by digest, with
    partial sums; a digest of a third of the rows is one row there, and its records are split by
    adaptive execution in the join.
    """
    firsts = (
        found.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        found.join(firsts, F.col("payload_digest") == F.col("_digest"), "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_digest", "_first")
    )


def _record(date: str) -> Column:
    """One record without the separator that follows it."""
    revisit = F.col("record_type") == "revisit"
    ident = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    headers = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", ident("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, line("WARC-Refers-To", ident("refers_to"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        F.when(~revisit, F.lit("Content-Type: text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    )
    return F.concat(headers, F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Write resolved records. A file holds at most ``records_per_file`` of them; readers stream a file."""
    (
        records.select(_record(date).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


class _Stream:
    """Reads of an exact length or up to a mark from compressed bytes, a piece at a time."""

    def __init__(self, packed: bytes, step: int = 1 << 20):
        self.packed, self.step, self.at, self.held = memoryview(packed), step, 0, bytearray()
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= len(self.packed):
            return False
        self.held += self.unzip.decompress(self.packed[self.at : self.at + self.step])
        self.at += self.step
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one compressed archive."""
    stream = _Stream(packed)
    while (head := stream.until(END.encode())) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(len(END)) != END.encode():
            raise ValueError("record without its end")
        yield headers, block


READ_SCHEMA = "page_id long, record_type string, uri string, header_digest string, payload_bytes long, payload_digest string, refers_to long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda s: None if s is None or s.endswith(":none>") else int(s.rpartition(":")[2][:-1])
    columns = READ_SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for h, block in parse(content):
                rows.append((
                    number(h["WARC-Record-ID"]), h["WARC-Type"], h.get("WARC-Target-URI"),
                    h["WARC-Payload-Digest"].removeprefix("sha256:"), len(block), hashlib.sha256(block).hexdigest(), number(h.get("WARC-Refers-To")),
                ))
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; bytes and digest are those of the block that was read. One task per file."""
    # an empty input leaves a folder without files
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_read, READ_SCHEMA)


def restore(read: DataFrame) -> DataFrame:
    """Join revisits to their responses: the size of a revisit's payload is that of the block it refers to.

    A block whose digest is not the one of its header raises an error, and so does a revisit without response.
    """
    whole = read.where("record_type = 'response'")
    broken = F.raise_error(F.concat(F.lit("payload of page "), F.col("page_id").cast("string"), F.lit(" does not fit its digest")))
    whole = whole.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("header_digest"), F.col("payload_digest")).otherwise(broken))
    # repeated rows of a response are one target
    targets = (
        whole.where("payload_bytes > 0").groupBy(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_digest")).agg(F.first("payload_bytes").alias("_bytes"))
    )
    lost = F.raise_error(F.concat(F.lit("no response for page "), F.col("page_id").cast("string")))
    again = read.where("record_type = 'revisit'").join(
        targets, (F.col("refers_to") == F.col("_to")) & (F.col("header_digest") == F.col("_digest")), "left"
    )
    again = again.withColumns({"payload_bytes": F.coalesce("_bytes", lost.cast("long")), "payload_digest": F.col("header_digest")})
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(*cols).unionByName(again.select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(resolve(captures(table(spark, sf_dir, "pages"))), path)
    return restore(read_archives(spark, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
