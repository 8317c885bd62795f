from pyspark.sql import functions as F

from gleaner.operators import allowlist as A
from gleaner.sources import allowlist as AS


def _al(spark, *entries):
    return AS.from_rows(spark, [dict(domain=d, purpose=p, ttl_class=t, added_at="2026-05-13") for d, p, t in entries])


def _has(spark, al, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    out = A.lookup(df, "url", al).orderBy("i").collect()
    return [r["al_domain"] is not None for r in out]


def test_exact_and_subdomain(spark):
    al = _al(spark, ("harbour.example", "x", "generic"), ("met.example.net", "x", "generic"))
    assert _has(spark, al, ["https://harbour.example", "http://harbour.example:8080/tides#low", "https://met.example.net/?day=2",
                            "https://buoys.north.met.example.net/log"]) == [True] * 4


def test_rejects_off_list_suffix_trick_and_malformed(spark):
    al = _al(spark, ("harbour.example", "x", "generic"))
    assert _has(spark, al, ["https://lighthouse.example/", "https://harbour.example.lighthouse.example/", "https://myharbour.example/",
                            "harbour.example", "https://", None]) == [False] * 6


def test_lowercases_host(spark):
    al = _al(spark, ("harbour.example", "x", "generic"))
    assert _has(spark, al, ["https://Pilot.HARBOUR.Example/Boats"]) == [True]


def test_longest_suffix_wins_and_ttl(spark):
    al = _al(spark, ("gov.uk", "broad", "generic"), ("hmrc.gov.uk", "narrow", "airline"))
    df = spark.createDataFrame([("https://hmrc.gov.uk/x",), ("https://other.com/",), ("https://www.gov.uk/",)], "url string")
    out = {r["url"]: r for r in A.lookup(df, "url", al).collect()}
    assert out["https://hmrc.gov.uk/x"]["al_purpose"] == "narrow"
    assert out["https://hmrc.gov.uk/x"]["al_ttl_seconds"] == 3600
    assert out["https://other.com/"]["al_domain"] is None
    assert out["https://www.gov.uk/"]["al_domain"] == "gov.uk"
    assert out["https://www.gov.uk/"]["al_ttl_seconds"] == 604800


def test_duplicate_domain_first_entry_wins(spark):
    al = _al(spark, ("example.com", "first", "generic"), ("example.com", "second", "airline"))
    df = spark.createDataFrame([("https://a.example.com/",)], "url string")
    assert A.lookup(df, "url", al).collect()[0]["al_purpose"] == "first"


def test_lookup_of_unparsable_and_off_list_urls(spark):
    al = _al(spark, ("gov.uk", "broad", "generic"), ("hmrc.gov.uk", "narrow", "airline"), ("example.com", "x", "generic"))
    df = spark.createDataFrame([(u,) for u in ["https://hmrc.gov.uk/x", "https://a.b.gov.uk/", "https://nope.org/",
                                                "not a url", "https://EXAMPLE.com"]], "url string")
    got = {r["url"]: r["al_domain"] for r in A.lookup(df, "url", al).collect()}
    assert got["not a url"] is None and got["https://nope.org/"] is None


def test_lookup_sees_rows_added_to_the_allowlist(spark, tmp_path):
    path = str(tmp_path / "al")
    AS.from_rows(spark, [("example.com", "x", "generic", "2026-01-01")]).write.parquet(path)
    df = spark.createDataFrame([("https://a.b.c.example.net/",), ("https://example.com/",)], "url string")
    assert {r["al_domain"] for r in A.lookup(df, "url", spark.read.parquet(path)).collect()} == {None, "example.com"}
    AS.from_rows(spark, [("b.c.example.net", "y", "generic", "2026-01-01")]).write.mode("append").parquet(path)
    assert {r["al_domain"] for r in A.lookup(df, "url", spark.read.parquet(path)).collect()} == {"b.c.example.net", "example.com"}


def test_gate_stays_shut_for_misleading_urls(spark):
    al = AS.from_rows(spark, [("example.com", "x", "generic", "2026-01-01")])
    shut = ["https://evil.com\\.example.com/", "https://example.com:99999/", "https://a<b.example.com/", "https://evil.com?@example.com/"]
    ok = [" https://example.com/ ", "https:\\\\example.com\\x", "https://me@evil.com@example.com/", "https://exam\nple.com/"]
    df = spark.createDataFrame([(u,) for u in shut + ok], "url string")
    got = {r["url"]: r["al_domain"] for r in A.lookup(df, "url", al).collect()}
    assert [u for u in shut if got[u]] == [] and [u for u in ok if not got[u]] == []


def test_validation_messages(spark):
    good = ("harbour.example", "tide tables", "airline", "2025-11-02")
    bad = {"domain": "Harbour_Master", "ttl_class": "hourly", "added_at": "02.11.2025", "purpose": None, "added_at_date": "2025-04-31"}
    place = {"domain": 0, "purpose": 1, "ttl_class": 2, "added_at": 3, "added_at_date": 3}
    for rule, value in bad.items():
        row = list(good)
        row[place[rule]] = "" if value is None else value
        v = A.validate(AS.from_rows(spark, [tuple(row)])).collect()[0]
        assert v["ok"] is False and v["bad_rule"] == rule and v["bad_index"] == 0
    v = A.validate(AS.from_rows(spark, [good, good, ("-pier.example", "x", "generic", "2025-11-02")])).collect()[0]
    assert v["bad_index"] == 2 and v["message"] == 'entry 2 has invalid "domain"'
    v = A.validate(AS.from_rows(spark, [good, ("met.example.net", "forecasts", "generic", "2024-02-29"), good])).collect()[0]
    assert v["ok"] is True and v["n_entries"] == 3


def test_yaml_loader(spark):
    import pytest

    df = AS.from_yaml_text(spark, "entries:\n- {domain: bees.example, ttl_class: airline, added_at: 2025-11-02,\n"
                                  "   purpose: hive logs}\n")
    r = df.collect()[0]
    assert r["added_at"] == "2025-11-02" and r["entry_index"] == 0 and r["purpose"] == "hive logs"
    for text, msg in [("foo: 1", "entries"), ("entries: 3", "not an array"), ("entries: []", "empty"),
                      ("entries: [{domain: a.example}, 7]", "entry 1 is not an object")]:
        with pytest.raises(AS.AllowlistSourceError, match=msg):
            AS.from_yaml_text(spark, text)
