import datetime as dt
import json
import os

import pytest

from gleaner import schemas as S
from gleaner.operators import requests as R
from gleaner.plans import service
from gleaner.sources import allowlist as AS
from gleaner.sources import requests as RS
from gleaner.streaming import admission as SA

TRACE = "0b1c2d3e-4f50-7a6b-9c7d-8e9fa0b1c2d3"
PAGE = ("<html><head><title>Tides</title></head><body><article><p>"
        + "High water comes later every day by some fifty minutes. " * 10 + "</p></article></body></html>")


def fetch_line(task, url="https://tides.example/today", **more):
    return json.dumps({"contract_id": S.CONTRACT_FETCH, "trace_id": TRACE, "dedupe_key": "d", "source_ref": task,
                       "caller_agent_id": "agent", "url": url, **more})


def put(folder, name, lines, minute):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    at = dt.datetime(2024, 2, 1, 0, minute, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (at, at))


def test_lines_are_numbered_in_order_of_arrival(spark, tmp_path):
    put(tmp_path / "in", "b.ndjson", [f"b{i}" for i in range(5)], 1)
    put(tmp_path / "in", "a.ndjson", [f"a{i}" for i in range(40)], 2)
    put(tmp_path / "in", "c.ndjson", [], 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, batch in (("128m", "10000"), ("32", "3")):  # one split a file, then many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            lines = RS.read_lines(spark, str(tmp_path / "in"))
            assert (lines.select("file_path", "block_start").distinct().count() > 3) == (size == "32")
            got = [(r.seq, r.value) for r in RS.numbered_lines(lines).orderBy("seq").collect()]
            assert got == list(enumerate([f"b{i}" for i in range(5)] + [f"a{i}" for i in range(40)] + [""]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])


def test_request_files_in_response_lines_out(spark, tmp_path):
    """The README's example."""
    al = AS.from_rows(spark, [dict(domain="tides.example", purpose="x", ttl_class="generic", added_at="2024-01-01")])
    search = json.dumps({"contract_id": S.CONTRACT_SEARCH, "trace_id": TRACE, "dedupe_key": "d", "source_ref": "task:s",
                         "caller_agent_id": "agent", "query": "high water"})
    put(tmp_path / "in", "1.ndjson", [fetch_line("task:1"), "not json", "", fetch_line("task:1", "https://other.example/")], 1)
    put(tmp_path / "in", "2.ndjson", [fetch_line("task:1"), search, fetch_line("task:1", contract_id="web.crawl.v1")], 2)
    crawl = spark.createDataFrame([("https://tides.example/today", 200, "text/html", bytearray(PAGE.encode()), None, None)], S.CRAWL)
    payload = '{"web": {"results": [{"title": "T", "url": "https://tides.example/x", "description": "d"}]}}'
    upstream = spark.createDataFrame([(5, 200, payload)], "seq long, http_status int, payload_json string")
    lines = RS.numbered_lines(RS.read_lines(spark, str(tmp_path / "in")))
    out = service.serve(lines, al, spark.createDataFrame([], S.FETCHED_PAGES), crawl, upstream)
    got = {r.seq: (r.code, json.loads(r.response)) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "ok", 1: "bad_query", 3: "not_allowlisted", 4: "ok", 5: "ok", 6: "validation_failed"}
    assert got[0][1]["status"] == "ok" and got[4][1]["status"] == "cache_hit" and got[4][1]["plaintext"] == got[0][1]["plaintext"]
    assert got[5][1]["results"][0]["snippet"] == "d" and got[1][1]["message"] == "invalid JSON"


def test_equal_keys_and_lines_beyond_the_cap(spark):
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    big = '{"contract_id": "' + "x" * S.MAX_REQUEST_LINE_BYTES + '"}'
    rows = [(1, '{"contract_id": "web.crawl.v1", "contract_id": "web.fetch.v1"}'), (2, big), (3, big + "]"), (4, '{"a": 1} x')]
    lines = spark.createDataFrame(rows, "seq int, value string")
    got = {r.seq: (r.parse_error, r.contract_id_raw) for r in R.validate(R.parse_lines(lines)).collect()}
    assert got == {1: (None, "web.fetch.v1"), 2: ("too_large", None), 3: ("too_large", None), 4: ("invalid_json", None)}


def admitted(spark, root, cap=5, ttl_ms=None):
    q = SA.admit_files(RS.read_lines_stream(spark, f"{root}/in", 1), f"{root}/out", f"{root}/ckpt", cap, ttl_ms)
    q.awaitTermination()
    out = spark.read.schema(SA.OUTPUT).parquet(f"{root}/out")
    return {(os.path.basename(r.file_path), r.place): r.code for r in out.collect()}


def test_stream_admission_counts_across_files_and_restarts(spark, tmp_path):
    put(tmp_path / "in", "1.ndjson", [fetch_line("task:a")] * 3 + ["", "nope", "[]"] + [fetch_line("task:b")], 1)
    put(tmp_path / "in", "2.ndjson", [fetch_line("task:a")], 2)
    first = admitted(spark, tmp_path)
    assert first == {("1.ndjson", i): c for i, c in enumerate(
        ["admitted"] * 3 + [None, "bad_query", "validation_failed", "admitted"]) if c} | {("2.ndjson", 0): "admitted"}
    put(tmp_path / "in", "3.ndjson", [fetch_line("task:a")] * 3 + [fetch_line("task:b")], 3)  # after a restart
    out = admitted(spark, tmp_path)
    assert out.items() >= first.items()
    assert [out["3.ndjson", i] for i in range(4)] == ["admitted", "budget_exhausted", "budget_exhausted", "admitted"]


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_stream_admission_of_a_hot_task(spark, tmp_path, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        put(tmp_path / "in", "1.ndjson", [fetch_line("task:hot") if i % 3 else fetch_line(f"task:{i}") for i in range(300)], 1)
        out = admitted(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    hot = [out["1.ndjson", i] for i in range(300) if i % 3]
    assert hot == ["admitted"] * 5 + ["budget_exhausted"] * 195
    assert all(out["1.ndjson", i] == "admitted" for i in range(0, 300, 3))


def test_stream_admission_forgets_after_its_ttl(spark, tmp_path):
    put(tmp_path / "in", "1.ndjson", [fetch_line("task:a")] * 2, 1)
    assert set(admitted(spark, tmp_path, cap=2, ttl_ms=1).values()) == {"admitted"}
    put(tmp_path / "in", "2.ndjson", [fetch_line("task:a")] * 3, 2)
    out = admitted(spark, tmp_path, cap=2, ttl_ms=1)
    assert [out["2.ndjson", i] for i in range(3)] == ["admitted", "admitted", "budget_exhausted"]


def test_lines_of_a_stream_keep_their_numbers_when_files_are_split(spark):
    from gleaner.plans import q_requests, q_streaming

    SF_SMALL = "/root/testdata/sf0.001"

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # splits by the bytes of each read and the cores
    try:
        lines = RS.numbered_lines(RS.read_lines(spark, q_requests.text_dir(spark, SF_SMALL))).where("trim(value) <> ''")
        got = q_streaming.stream_admission(spark, SF_SMALL)
        assert sorted(r.line for r in got.collect()) == sorted(r.seq for r in lines.collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_decided_rows_make_few_groups(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000, numPartitions=1).select(
        F.concat(F.lit("task:"), F.col("id") % 30).alias("source_ref"), F.lit(None).cast("string").alias("code"),
        F.timestamp_seconds("id").alias("ts"), F.lit("f").alias("file_path"), F.lit(0).cast("long").alias("block_start"),
        F.col("id").alias("place"))
    out = SA.keyed(rows, 5)
    assert out.select("source_ref", "salt").distinct().count() <= 30 + SA.SALTS
    assert out.where("salt = 0").count() == 150 and out.select("ref").distinct().count() == 30
