"""WARC round trips, revisits and range reads."""

import hashlib

import pytest

from codonframe.llm import warc

BIG = "<p>" + "x" * 200 + "</p>"
SCHEMA = "page_id long, url string, html string, offset string, record_type int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


def test_records_round_trip(spark):
    rows = [(5, "http://a/ b\r\n", BIG), (3, "http://b", BIG), (9, None, BIG), (None, "u", BIG), (1, "http://c", None), (2, "", ""), (4, "é", "short"), (6, "f", "short"), (7, "long", "ü\r\n\r\n" * 300_000), (3, "http://b", BIG)]
    index = warc.write_archives(pages(spark, rows))
    found = warc.read_records(index, with_payload=True).collect()
    assert len(found) == len(rows)
    texts = {(i, u): (t or "").encode() for i, u, t in rows}
    for r in found:
        body = texts[r.page_id, r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        revisit = body == BIG.encode() and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else body)


def test_a_revisit_leads_to_its_payload(spark):
    index = warc.write_archives(pages(spark, [(1, "a", BIG), (2, "b", BIG)]))
    at = warc.resolved(index, index.where("page_id = 2"))
    found = warc.read_records(at, with_payload=True).first()
    assert bytes(found.payload).decode() == BIG


def test_only_selected_records_are_read(spark):
    index = warc.write_archives(pages(spark, [(i, f"u{i}", f"page {i}") for i in range(50)]))
    found = warc.read_records(index.where("page_id % 7 = 0")).collect()
    assert sorted(r.page_id for r in found) == list(range(0, 50, 7))


def test_ranges_are_coalesced():
    near = [("f", 0, 10), ("f", 10, 10), ("f", 30, 5), ("f", 200_000, 5), ("g", 0, 5)]
    assert [(f, a, b, len(h)) for f, a, b, h in warc._ranges(near)] == [("f", 0, 35, 3), ("f", 200_000, 200_005, 1), ("g", 0, 5, 1)]


def test_damage_is_noticed():
    good = warc.record_bytes(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), "response", None)
    import zlib

    headers, payload, size = warc.parse_record(zlib.compress(good, wbits=31))
    assert (payload, size, headers["warc-target-uri"]) == (b"body", 4, "u")
    with pytest.raises(zlib.error):
        warc.parse_record(zlib.compress(good, wbits=31)[:-12] + b"0" * 12)


def test_no_pages(spark):
    assert warc.read_records(warc.write_archives(pages(spark, []))).count() == 0
