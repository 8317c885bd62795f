import hashlib
import base64

import pytest
from pyspark.sql import functions as F

from gleaner.llm import warc


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(1, "http://a/1", "same body"), (2, "http://a/2", "same body"), (3, None, None), (4, "http://a/4", ""),
         (5, "http://a/5", "über 😀 " * 900), (6, "http://a/6", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50),
         (7, "http://a/7", "unique"), (7, "http://a/7", "unique"), (8, "http://a\r\nx: y", "line\nends\r\n"),
         (9, "u", "big repeated " * 700), (9, "u", "big repeated " * 700), (None, "http://n", "nobody")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)


def _read(spark, path):
    return warc.pages_of(warc.reassemble(warc.read_records(spark, path))).collect()


@pytest.mark.parametrize("revisit_bytes", [0, 7])
def test_round_trip(spark, pages, revisit_bytes):
    path = warc.write_archive(pages, revisit_bytes=revisit_bytes, segment_bytes=1000, chunk_bytes=300)
    got = _read(spark, path)
    assert len(got) == len(PAGES) and all(r.valid for r in got)
    want = []
    for page, _, body in PAGES:
        raw = (body or "").encode()
        group = [p for p, _, b in PAGES if (b or "") == (body or "") and p is not None]
        top = max(group, default=None)
        shared = len(raw) >= revisit_bytes and top is not None and page != top
        want.append((page, len(raw), _digest(body), "revisit" if shared else "response", top if shared else None))
    have = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            body = next(b for p, _, b in PAGES if p == int(r.page_id))
            assert bytes(r.payload) == (body or "").encode()


def test_records_are_well_formed(spark, pages):
    path = warc.write_archive(pages, segment_bytes=1000)
    rows = warc.read_records(spark, path).collect()
    ids = [r.headers["warc-record-id"] for r in rows]
    assert len(set(ids)) == len(ids)
    named = set(ids)
    for r in rows:
        assert int(r.headers["content-length"]) == len(r.block) <= 1000
        if r.type == "revisit" and r.headers["warc-payload-digest"] != "sha1:" + _digest("unique"):
            if "big" not in r.headers["warc-target-uri"]:
                assert r.headers["warc-refers-to"] in named
        if r.type == "continuation":
            assert r.headers["warc-segment-origin-id"] in named


def test_broken_segments_are_told(spark, pages):
    path = warc.write_archive(pages.where("page_id in (5, 7)"), segment_bytes=1000)
    records = warc.read_records(spark, path)
    last = F.col("headers")["warc-segment-total-length"].isNotNull()
    middle = F.col("headers")["warc-segment-number"] == "3"
    for gone in (last, middle):
        found = warc.pages_of(warc.reassemble(records.where(~F.coalesce(gone, F.lit(False))))).collect()
        assert sorted((r.page_id, r.valid) for r in found) == [("5", False), ("7", True), ("7", True)]
    shuffled = warc.pages_of(warc.reassemble(records.repartition(7))).collect()
    assert all(r.valid for r in shuffled) and len(shuffled) == 3


def test_dechunk():
    assert warc.dechunk(warc.chunked("aß" * 50, 7).encode()) == ("aß" * 50).encode()
    assert warc.dechunk(b"5;ext=1\r\nhello\r\n0\r\n\r\n") == b"hello"
    for bad in (b"5\r\nhel", b"zz\r\n\r\n", b"5\r\nhelloX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)


def test_nothing(spark, pages):
    assert _read(spark, warc.write_archive(pages.limit(0))) == []
