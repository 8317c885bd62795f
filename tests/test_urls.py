from gleaner.functions import urls as U
from gleaner.functions import text as X


def test_host_origin_canonical(spark):
    cases = [
        ("https://Example.COM:443/a?b#c", "example.com", "https://example.com", "https://example.com/a?b"),
        ("http://user:pw@a.b.org:8080/x", "a.b.org", "http://a.b.org:8080", "http://a.b.org:8080/x"),
        ("https://host_with_underscore.example.com/", "host_with_underscore.example.com",
         "https://host_with_underscore.example.com", "https://host_with_underscore.example.com/"),
        ("https://example.com", "example.com", "https://example.com", "https://example.com/"),
        ("not a url", None, "not a url", "not a url"),
        ("brave-search://q?top_n=5", "q", "null", None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    out = {r["url"]: r for r in df.select("url", U.hostname("url").alias("h"), U.origin("url").alias("o"),
                                          U.canonical_url("url").alias("c")).collect()}
    for url, h, o, c in cases:
        assert out[url]["h"] == h, url
        assert out[url]["o"] == o, url
        if c is not None:
            assert out[url]["c"] == c, url


def test_uri_component_matches_js(spark):
    df = spark.createDataFrame([("a b*(é)!~'",)], "q string")
    assert df.select(X.uri_component("q")).collect()[0][0] == "a%20b*(%C3%A9)!~'"


def test_whitespace_and_sha(spark):
    df = spark.createDataFrame([("  a  \n b﻿",)], "s string")
    r = df.select(X.collapse_ws("s").alias("c"), X.sha256_hex(X.collapse_ws("s")).alias("h")).collect()[0]
    assert r["c"] == "a b"
    assert r["h"] == "c8687a08aa5d6ed2044328fa6a697ab8e96dc34291e8c2034ae8c38e6fcc6d65"


def test_decode_body_lossy(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfab\xffc"),)], "b binary")
    assert df.select(X.decode_body("b")).collect()[0][0] == "ab�c"
