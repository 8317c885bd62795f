from gleaner import schemas as S
from gleaner.operators import health as H


def _v(spark, rows):
    return H.verdict(spark.createDataFrame(rows, S.PROBE)).collect()[0]


GOOD = [(0, "example.com", 1, 0, None, 200, None), (1, "gov.uk", 1, 1, None, 200, None)]


def test_all_good(spark):
    assert _v(spark, GOOD)["status"] == "ok"


def test_no_records_is_dns_failure_with_index(spark):
    v = _v(spark, [GOOD[0], (1, "gov.uk", 0, 0, None, 200, None)])
    assert (v["status"], v["step"], v["dependency"], v["entry_index"]) == ("fail", "dns", "gov.uk", 1)
    assert v["upstream_error"] == "ENOTFOUND (no A or AAAA records)"
    assert v["ranked_causes"].startswith("domain decommissioned or renamed")


def test_dns_throws(spark):
    v = _v(spark, [(0, "example.com", 0, 0, "boom", None, None)])
    assert v["step"] == "dns" and v["upstream_error"] == "boom"
    assert "host-side network filter blocking DNS" in v["ranked_causes"]


def test_dns_before_head_and_head_failures(spark):
    v = _v(spark, [(0, "a.com", 1, 0, None, 503, None), (1, "b.com", 0, 0, None, 200, None)])
    assert v["step"] == "dns" and v["entry_index"] == 1
    v = _v(spark, [GOOD[0], (1, "gov.uk", 1, 0, None, 503, None)])
    assert v["step"] == "head" and v["upstream_error"] == "HTTP 503" and v["entry_index"] == 1
    v = _v(spark, [(0, "a.com", 1, 0, None, None, "read ECONNRESET")])
    assert v["step"] == "head" and v["upstream_error"] == "read ECONNRESET"


def test_aaaa_only_and_3xx_pass(spark):
    assert _v(spark, [(0, "a.com", 0, 1, None, 200, None)])["status"] == "ok"
    assert _v(spark, [(0, "a.com", 1, 0, None, 301, None)])["status"] == "ok"
