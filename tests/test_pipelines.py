import datetime as dt

from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.plans import fetch as FP
from gleaner.plans import search as SP
from gleaner.sources import allowlist as AS

ARTICLE = ("<html><head><title>Example Article</title></head><body><article><p>"
           + "Plenty of useful words about insurance premiums, and more. " * 10 + "</p></article></body></html>")
SIGN_IN = "<html><head><title>Sign in</title></head><body><p>Please sign in.</p></body></html>"


def _al(spark):
    return AS.from_rows(spark, [dict(domain="example.com", purpose="x", ttl_class="airline", added_at="2026-05-13")])


def test_fetch_pipeline_cases(spark):
    crawl = spark.createDataFrame([
        ("https://example.com/article", 200, "text/html", bytearray(ARTICLE.encode()), None, None),
        ("https://example.com/signin", 200, "text/html", bytearray(SIGN_IN.encode()), None, None),
        ("https://example.com/forbidden", 403, "text/html", bytearray(b""), None, None),
    ], S.CRAWL)
    t0 = dt.datetime(2026, 5, 13, 7, 0, 0)
    reqs = spark.createDataFrame([
        (1, t0, "https://example.com/article", False),
        (2, t0, "https://evil.com/x", False),
        (3, t0, "https://example.com/signin", False),
        (4, t0, "https://example.com/forbidden", False),
        (5, t0 + dt.timedelta(minutes=10), "https://example.com/article", False),
        (6, t0 + dt.timedelta(minutes=20), "https://example.com/article", True),
        (7, t0 + dt.timedelta(minutes=30), "https://example.com/signin", False),
    ], "seq long, now timestamp, url string, bypass_cache boolean") \
        .withColumn("requesting_agent_id", F.lit("agent")).withColumn("task_id", F.lit("task:1")) \
        .withColumn("trace_id", F.lit("t"))
    snap = spark.createDataFrame([], S.FETCHED_PAGES)
    res = FP.fetch_pipeline(reqs, _al(spark), snap, crawl)
    o = {r["seq"]: r for r in res.outcomes.collect()}
    assert o[1]["status"] == "ok" and o[1]["title"] == "Example Article"
    assert o[2]["status"] == "off_allowlist" and o[2]["code"] == "not_allowlisted"
    assert (o[3]["status"], o[3]["reason"]) == ("low_signal", "captcha_or_paywall")
    assert (o[4]["status"], o[4]["reason"]) == ("low_signal", "non_2xx")
    assert o[5]["status"] == "cache_hit" and o[5]["fetched_at"] == "2026-05-13T07:00:00.000Z"
    assert o[5]["content_sha256"] == o[1]["content_sha256"]
    assert o[6]["status"] == "ok" and o[6]["fetched_at"] == "2026-05-13T07:20:00.000Z"
    assert (o[7]["status"], o[7]["reason"]) == ("low_signal", "cached_low_signal")
    prov = sorted(r["request_seq"] for r in res.provenance.collect())
    assert prov == [1, 5, 6, 7]  # fresh low-signal pages record no provenance
    snap2 = {r["url"]: r for r in res.snapshot.collect()}
    assert snap2["https://example.com/article"]["write_seq"] == 6
    assert snap2["https://example.com/signin"]["low_signal"] is True
    assert snap2["https://example.com/signin"]["title"] == "Sign in"
    assert snap2["https://example.com/forbidden"]["title"] is None
    lines = [r["response"] for r in FP.responses(res).collect()]
    assert any('"code":"not_allowlisted"' in x for x in lines)


def test_search_pipeline_cases(spark):
    payload = ('{"web": {"results": ['
               '{"title": "A", "url": "https://example.com/a", "description": "d"},'
               '{"title": 5, "url": "https://example.com/bad", "description": "d"},'
               '{"title": "Off", "url": "https://other.org/x", "description": "d"},'
               '{"title": "B", "url": "https://www.example.com/b", "description": "d"},'
               '{"title": "C", "url": "https://example.com/c"}]}}')
    now = dt.datetime(2026, 5, 13, 7, 0, 0)
    reqs = spark.createDataFrame([
        (1, now, "  council tax  ", 5, None, None),
        (2, now, "q", 1, "week", None),
        (3, now, "q", 5, None, ["example.com"]),
        (4, now, "q", 5, None, ["other.org"]),
        (5, now, "  ", 5, None, None),
        (6, now, "q", 5, None, None),
    ], "seq long, now timestamp, query string, top_n int, freshness string, site_filter array<string>") \
        .withColumn("caller_agent_id", F.lit("agent")).withColumn("source_ref", F.lit("task:1")) \
        .withColumn("trace_id", F.lit("t"))
    pays = spark.createDataFrame([(1, 200, payload), (2, 200, payload), (3, 200, payload), (4, 200, payload),
                                  (5, 200, payload), (6, 503, "")], "seq long, http_status int, payload_json string")
    res = SP.search_pipeline(reqs, pays, _al(spark))
    o = {r["seq"]: r for r in res.outcomes.collect()}
    results = {}
    for r in res.results.collect():
        results.setdefault(r["seq"], []).append((r["result_rank"], r["url"]))
    assert o[1]["code"] == "ok" and o[1]["query"] == "council tax" and o[1]["freshness"] == "any"
    assert sorted(results[1]) == [(1, "https://example.com/a"), (2, "https://www.example.com/b")]
    assert o[2]["n_results"] == 1 and sorted(results[2]) == [(1, "https://example.com/a")]
    assert sorted(results[3]) == [(1, "https://example.com/a")]  # exact host, no subdomains
    assert o[4]["code"] == "bad_query" and "other.org" in o[4]["message"]
    assert o[5]["code"] == "bad_query" and o[5]["message"] == "query is empty"
    assert o[6]["code"] == "upstream_error"
    prov = {r["request_seq"]: r for r in res.provenance.collect()}
    assert sorted(prov) == [1, 2, 3]
    assert prov[1]["url"] == "brave-search://council%20tax?top_n=5&freshness=any"
    assert prov[1]["origin"] == "brave-search://"


def test_search_responses_json(spark):
    import json

    payload = '{"web": {"results": [{"title": "A", "url": "https://example.com/a", "description": "d"}]}}'
    now = dt.datetime(2026, 5, 13, 7, 0, 0)
    reqs = spark.createDataFrame([(1, now, "q", 5, None, None), (2, now, " ", 5, None, None)],
                                 "seq long, now timestamp, query string, top_n int, freshness string, "
                                 "site_filter array<string>") \
        .withColumn("caller_agent_id", F.lit("agent")).withColumn("source_ref", F.lit("task:1")) \
        .withColumn("trace_id", F.lit("t"))
    pays = spark.createDataFrame([(1, 200, payload), (2, 200, payload)], "seq long, http_status int, payload_json string")
    out = {r["seq"]: json.loads(r["response"]) for r in SP.responses(SP.search_pipeline(reqs, pays, _al(spark))).collect()}
    assert out[1]["ok"] is True and out[1]["results"] == [
        {"title": "A", "url": "https://example.com/a", "snippet": "d", "origin": "https://example.com"}]
    assert out[2] == {"ok": False, "code": "bad_query", "message": "query is empty", "trace_id": "t"}


def test_yaml_file_unreadable(spark, tmp_path):
    import pytest

    with pytest.raises(AS.AllowlistSourceError, match="cannot read"):
        AS.from_yaml_file(spark, str(tmp_path / "missing.yaml"))
