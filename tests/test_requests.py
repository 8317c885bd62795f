from pyspark.sql import functions as F

from gleaner.operators import budgets as B
from gleaner.operators import requests as R

TRACE = "01234567-89ab-7cde-8f01-23456789abcd"
SEARCH = ('{"contract_id":"web.search.v1","trace_id":"%s","dedupe_key":"k","source_ref":"task:1",'
          '"caller_agent_id":"a","query":"council tax bands","top_n":5}' % TRACE)
FETCH = ('{"contract_id":"web.fetch.v1","trace_id":"%s","dedupe_key":"k","source_ref":"task:1",'
         '"caller_agent_id":"a","url":"https://www.gov.uk/council-tax-bands"}' % TRACE)


def _validate(spark, lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "seq long, value string")
    out = R.validate(R.parse_lines(df)).orderBy("seq").collect()
    return {r["seq"]: r for r in out}


def test_valid_envelopes(spark):
    out = _validate(spark, [SEARCH, FETCH])
    assert out[0]["valid"] and out[1]["valid"]


def test_prechecks_and_rules(spark):
    lines = [
        '{"contract_id":"web.crawl.v1"}',
        "5",
        "[1,2]",
        '{"contract_id":5}',
        SEARCH.replace(TRACE, "not-a-uuid"),
        '{"contract_id":"web.search.v1"}',
        SEARCH.replace('"top_n":5', '"top_n":5.0'),
        SEARCH.replace('"top_n":5', '"top_n":25'),
        SEARCH.replace('"top_n":5', '"top_n":5,"extra":1'),
        FETCH.replace('"url":"https://www.gov.uk/council-tax-bands"', '"url":"not a uri"'),
        "not-json",
        SEARCH + " x",
        "   ",
    ]
    out = _validate(spark, lines)
    assert out[0]["errors"] == "unknown contract_id 'web.crawl.v1'"
    assert out[1]["errors"] == "envelope is not an object"
    assert out[2]["errors"] == "contract_id missing or not a string"
    assert out[3]["errors"] == "contract_id missing or not a string"
    assert out[4]["errors"] == "pattern:trace_id"
    assert out[5]["errors"].startswith("required:trace_id; required:dedupe_key")
    assert out[6]["valid"] is True  # 5.0 is an integer for JSON Schema
    assert out[7]["errors"] == "range:top_n"
    assert out[8]["errors"] == "additional:extra"
    assert out[9]["errors"] == "format:url"
    assert out[10]["parse_error"] == "invalid_json" and out[10]["valid"] is False
    assert out[11]["parse_error"] == "invalid_json"  # trailing text after JSON is rejected
    assert 12 not in out  # blank lines are skipped


def test_sixth_request_denied_and_invalid_do_not_consume(spark):
    rows = [(i, i, "task:budget-test", True) for i in range(6)] + [(10, 3, "task:budget-test", False)] + \
           [(11, 0, None, True)]
    df = spark.createDataFrame(rows, "seq long, ts long, source_ref string, valid boolean")
    out = B.task_budget(df.filter("valid"), "source_ref", ("ts", "seq")).orderBy("seq").collect()
    assert [r["budget_ok"] for r in out] == [True] * 5 + [False, True]


def test_budget_plans_group_limit_before_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("source_ref"),
                                 F.col("id").alias("ts"))
    ids = B.first_k_ids(df, "source_ref", ["ts", "seq"], 5, "seq")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert ids.count() == 15
    assert "WindowGroupLimit" in plan


def test_daily_and_monthly(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + (i % 2)} 00:00:00") for i in range(60)], "seq long, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    d = {r["day"]: r for r in B.daily_ops(df).collect()}
    assert d["2024-01-01"]["n_ops"] == 30 and d["2024-01-01"]["n_over_cap"] == 0
    m = B.monthly_spend(df).collect()[0]
    assert str(m["spend_usd"]) == "0.180000" and m["exhausted"] is False


def test_dedupe_key_stable(spark):
    df = spark.createDataFrame([("web.fetch.v1", "a", "https://Ex.com/x#frag", None, None, "cached"),
                                ("web.fetch.v1", "a", "https://ex.com/x", None, None, "cached")],
                               "c string, caller string, url string, query string, top_n int, freshness string")
    k = df.select(R.dedupe_key("c", "caller", "url", "query", "top_n", "freshness", None).alias("k")).collect()
    assert k[0]["k"] == k[1]["k"]


def test_strict_single_value_json(spark):
    cases = {'{}': True, '{} x': False, '{} {}': False, '{},{}': False, '{}] x': False, '{}} x': False,
             '{}, "w":1': False, '{"s":"}] x"}': True, '[1, 2]': True, '[1] x': False, '"a"}] x': False,
             '5': True, 'null': True, '{"a": [1, {"b": "]"}]}': True, '{"a": [1]} ]': False}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "seq long, value string")
    out = {r["value"]: r["parse_error"] is None for r in R.parse_lines(df).collect()}
    assert out == cases


def test_text_source_arrival_order(spark, tmp_path):
    from gleaner.sources import requests as RS

    d = tmp_path / "lines"
    d.mkdir()
    (d / "a.ndjson").write_text('{"n": 1}\n\n{"n": 2}\n{} x\n')
    df = RS.read_lines(spark, str(d))
    rows = df.orderBy("ts", "file_path", "block_start", "place").collect()
    assert [r["value"] for r in rows] == ['{"n": 1}', "", '{"n": 2}', "{} x"]
    parsed = R.parse_lines(df).orderBy("place").collect()
    assert [r["parse_error"] for r in parsed] == [None, None, "invalid_json"]


def test_hot_key_budget_limits_rows_before_the_shuffle(spark):
    """One source_ref holds a third of all rows: the group limit runs map-side (Partial) below the Exchange,
    so at most ``cap`` rows per key and map task are shuffled; the result stays exact."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("seq"), F.col("id").alias("ts"),
                               F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
                                   F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("source_ref"))
    ids = B.first_k_ids(df.repartition(8), "source_ref", ["ts", "seq"], 5, "seq")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    exch = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning(source_ref" in l)
    assert any("WindowGroupLimit" in l and "Partial" in l for l in lines[exch:])
    got = {r["seq"] for r in ids.collect()}
    assert {s for s in got if s % 3 == 0} == {0, 3, 6, 9, 12}
    assert len(got) == 5 + 500 * 4  # every cold key has 4 rows (all admitted), the hot key 5


def test_of_equal_keys_the_last_one_counts(spark):
    line = '{"contract_id": "web.fetch.v1", "contract_id": "web.crawl.v1"}'
    df = spark.createDataFrame([(1, line), (2, line + ' {}')], "seq int, value string")
    out = {r["seq"]: r for r in R.validate(R.parse_lines(df)).collect()}
    assert out[1]["parse_error"] is None and out[1]["errors"] == "unknown contract_id 'web.crawl.v1'"
    assert out[2]["parse_error"] == "invalid_json"
