import hashlib

import pytest

from shelfcast.functions.runtime import scratch_path
from shelfcast.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload string, _first string"
BIG, TRICKY = "<p>" + "x" * 200, "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20


def run(spark, rows):
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)
    warc.write_archives(warc.resolve(warc.captures(pages)), path, records_per_file=3)
    return warc.restore(warc.read_archives(spark, path))


def test_revisits_refer_to_the_smallest_page(spark):
    rows = [(7, "http://a", BIG), (3, "http://b\r\nX: y", BIG), (9, None, BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (5, "u", TRICKY), (6, "u", TRICKY)]
    got = {r.page_id: r for r in run(spark, rows).collect()}
    assert len(got) == 8
    for page, _, html in rows:
        body = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {7: 3, 9: 3, 6: 5}


def test_hundred_bytes_are_enough_and_ties_repeat(spark):
    at, under = "y" * 100, "z" * 99
    got = run(spark, [(1, "u", at), (2, "u", at), (1, "u", at), (3, "u", under), (4, "u", under)]).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (1, "response"), (2, "revisit"), (3, "response"), (4, "response")]


def test_null_ids_and_no_pages(spark):
    got = run(spark, [(None, "u", BIG), (5, "u", BIG), (None, "u", TRICKY), (None, "u", TRICKY)]).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to or 0) for r in got) == [
        ("5", "response", 0), ("None", "response", 0), ("None", "response", 0), ("None", "revisit", 5)]
    assert run(spark, []).count() == 0


def test_a_hot_payload_is_stored_once(spark):
    path = scratch_path(spark, "warc")
    pages = spark.range(400).selectExpr("id + 10 AS page_id", "'u' AS url", f"CASE WHEN id % 2 = 0 THEN '{BIG}' ELSE concat('{BIG}', id) END AS html")
    warc.write_archives(warc.resolve(warc.captures(pages)), path)
    read = warc.read_archives(spark, path)
    assert read.where("record_type = 'revisit'").count() == 199
    assert {r.refers_to for r in read.where("record_type = 'revisit'").collect()} == {10}
    assert warc.restore(read).where(f"payload_bytes = {len(BIG)}").count() == 200


def test_a_broken_archive_is_an_error():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))
