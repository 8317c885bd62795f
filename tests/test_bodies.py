import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import crawl as C
from gleaner.operators.ranges import running_sum

HEAD = "fetch_id long, url string, status int, content_type string, error_name string, final_url string, has_body boolean"
CHUNK = "fetch_id long, chunk_no int, bytes binary, error string"


def triaged(spark, heads, chunks, cap):
    t = C.triage(C.read_bodies(spark.createDataFrame(heads, HEAD), spark.createDataFrame(chunks, CHUNK).repartition(3), cap), cap)
    return {r.fetch_id: (r.reason, r.doc_status, r.doc_url, r.byte_size, r.body_text) for r in t.collect()}


def head(i, status=200, error=None, kind="text/html", has_body=True):
    return (i, f"https://tides.example/{i}", status, kind, error, f"https://tides.example/to/{i}", has_body)


def test_bodies_are_read_up_to_the_cap_or_the_failure(spark):
    heads = [head(1), head(2), head(3), head(4), head(5), head(6, status=404), head(7, error="AbortError"), head(8, has_body=False),
             head(9), head(10, kind="application/pdf"), head(11)]
    chunks = [(1, 2, b"\xa9!", None), (1, 0, b"ab", None), (1, 1, b"\xc3", None),  # a character across chunks, out of order
              (2, 0, b"12345", None), (2, 1, b"67890X", None), (2, 2, b"never read", None),
              (3, 0, b"123", None), (3, 1, None, "AbortError"), (3, 2, b"late", None),
              (4, 0, None, "ECONNRESET"), (5, 0, b"12345", None), (5, 1, None, None), (5, 2, b"67890", None),
              (6, 0, b"not found", None), (7, 0, b"x", None), (10, 0, b"pdf", None), (99, 0, b"nobody's", None),
              (11, 0, b"1234567890x", None), (11, 1, None, "AbortError")]
    assert triaged(spark, heads, chunks, 10) == {
        1: (None, 200, "https://tides.example/to/1", 5, "abé!"), 2: ("over_size_cap", 200, "https://tides.example/to/2", 11, ""),
        3: ("timeout", 200, "https://tides.example/to/3", 3, ""), 4: ("transport_error", 200, "https://tides.example/to/4", 0, ""),
        5: (None, 200, "https://tides.example/to/5", 10, "1234567890"), 6: ("non_2xx", 404, "https://tides.example/to/6", 0, ""),
        7: ("timeout", 0, "https://tides.example/7", 0, ""), 8: ("transport_error", 200, "https://tides.example/to/8", 0, ""),
        9: (None, 200, "https://tides.example/to/9", 0, ""), 10: ("invalid_content_type", 200, "https://tides.example/to/10", 0, ""),
        11: ("over_size_cap", 200, "https://tides.example/to/11", 11, "")}


def test_bodies_of_nothing(spark):
    assert triaged(spark, [], [], 10) == {}


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_sum_of_a_hot_key(spark, coalesce):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = spark.range(3000).selectExpr("if(id % 3 = 0, id, -1) as k", "id as n", "cast(id % 5 as long) as size")
        got = running_sum(rows, ["k"], ["n"], "size", "total").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want, sums = {}, {}
    for i in range(3000):
        k = i if i % 3 == 0 else -1
        sums[k] = want[i] = sums.get(k, 0) + i % 5
    assert {r.n: r.total for r in got} == want


def test_decoder_replaces_maximal_subparts(spark):
    rng = random.Random(3)
    pool = [b"a", b"\xc3", b"\xa9", b"\xe2", b"\x82", b"\xac", b"\xf0", b"\x9f", b"\x98", b"\x80", b"\xed", b"\xa0", b"\xc0", b"\xf4",
            b"\x90", b"\xf5", b"\xff", b"\xe0", b"\xbf", b"\xef\xbb\xbf"]
    rows = [(i, bytearray(b"".join(rng.choices(pool, k=rng.randrange(0, 10))))) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, b binary")
    for r in df.select("b", X.decode_body("b").alias("s")).collect():
        want = bytes(r.b).decode("utf-8", "replace")
        assert r.s == want.removeprefix("﻿")


def test_one_crawl_row_per_url(spark):
    rows = [("u", 1, 404, None), ("u", 2, 200, None), ("u", None, 200, None), ("v", 1, 200, "AbortError"), ("v", 1, 500, None), ("w", 1, 200, None)]
    df = spark.createDataFrame(rows, "url string, crawl_seq long, status int, error_name string").withColumns(
        {"final_url": F.col("url"), "more": F.create_map(F.lit("a"), F.lit(1))})
    got = {r.url: (r.crawl_seq, r.status) for r in C.one_per_url(df).collect()}
    assert got == {"u": (2, 200), "v": (1, 500), "w": (1, 200)}
    got = {r.url: r.status for r in C.one_per_url(df.drop("crawl_seq")).collect()}
    assert got == {"u": 200, "v": 500, "w": 200}
