import datetime as dt
import os
import tempfile

from gleaner.streaming import budget as SB


def test_budget_state_survives_across_micro_batches(spark):
    root = tempfile.mkdtemp(prefix="gleaner-stream-")
    schema = "seq long, ts timestamp, source_ref string"
    t0 = dt.datetime(2024, 1, 1)

    def run(rows, part):
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(root, "in", part))
        stream = spark.readStream.schema(schema).parquet(os.path.join(root, "in", "*"))
        q = (SB.budget_stream(stream).writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination()

    run([(i, t0 + dt.timedelta(minutes=i), "task:a") for i in range(4)], "p=1")
    run([(i, t0 + dt.timedelta(minutes=i), "task:a") for i in range(4, 8)] + [(9, t0, "task:b")], "p=2")
    out = {r["seq"]: r["budget_ok"] for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    assert [out[i] for i in range(8)] == [True] * 5 + [False] * 3
    assert out[9] is True


def test_budget_topk_across_small_chunks_is_exact(spark):
    """A hot key split into many Arrow chunks, later chunks holding earlier timestamps."""
    import random

    root = tempfile.mkdtemp(prefix="gleaner-stream-")
    schema = "seq long, ts timestamp, source_ref string"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=(97 * i) % 50), "task:hot") for i in range(50)]
    random.Random(7).shuffle(rows)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(root, "in", "p=1"))
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = spark.readStream.schema(schema).parquet(os.path.join(root, "in", "*"))
        q = (SB.budget_stream(stream).writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)
    out = {r["seq"]: r["budget_ok"] for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    expect = {seq for seq, _, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:5]}
    assert len(out) == 50
    assert {s for s, ok in out.items() if ok} == expect


def test_ingest_batch_writer_is_idempotent(spark):
    from pyspark.sql import functions as F

    from gleaner.streaming import ingest as SI

    root = tempfile.mkdtemp(prefix="gleaner-ingest-")
    snap_root, prov_root = os.path.join(root, "snapshot"), os.path.join(root, "prov")
    write = SI.make_batch_writer(snap_root, prov_root)

    def page(url, text, seq):
        return (url, "o", "s" + text, text, None, "2024-01-01T00:00:00.000Z", 3600, False, 1, seq)

    schema = SI.SNAPSHOT
    b0 = spark.createDataFrame([page("u1", "a", 1), page("u2", "b", 2), page("u1", "c", 3)], schema)
    b1 = spark.createDataFrame([page("u2", "d", 4)], schema)
    write(b0, 0)
    write(b1, 1)
    first = sorted((r["url"], r["plaintext"]) for r in SI.latest_snapshot(spark, snap_root).collect())
    write(b1, 1)  # a replayed batch finds its folders complete
    again = sorted((r["url"], r["plaintext"]) for r in SI.latest_snapshot(spark, snap_root).collect())
    assert first == again == [("u1", "c"), ("u2", "d")]
    assert SI.latest_snapshot(spark, snap_root, as_of=0).filter(F.col("url") == "u2").collect()[0]["plaintext"] == "b"


def test_ingest_writes_what_a_batch_brings_and_merges_now_and_then(spark):
    from gleaner.streaming import ingest as SI

    root = tempfile.mkdtemp(prefix="gleaner-ingest-")
    write = SI.make_batch_writer(os.path.join(root, "s"), os.path.join(root, "p"))

    def page(url, text, seq):
        return (url, "o", "s" + text, text, None, "2024-01-01T00:00:00.000Z", 3600, False, 1, seq)

    write(spark.createDataFrame([page(f"u{i}", "a" * 500, i) for i in range(3000)], SI.SNAPSHOT).coalesce(1), 0)
    want = {f"u{i}": "a" * 500 for i in range(3000)}
    for n in range(1, 12):
        rows = [page(f"u{i}", f"{n}", 10_000 * n + i) for i in range(n, 3000, 10)]
        want |= {r[0]: r[3] for r in rows}
        write(spark.createDataFrame(rows, SI.SNAPSHOT).coalesce(1), n)
    store = os.path.join(root, "s")
    assert SI._complete(spark, store, "run") == list(range(12))
    bases = SI._complete(spark, store, "base")
    assert bases[0] == 0 and 1 <= len(bases) - 1 <= 6
    weigh = lambda kind: [SI._bytes(spark, f"{store}/{kind}={b}") for b in SI._complete(spark, store, kind)]
    assert sum(weigh("base")) <= 3.5 * sum(weigh("run"))
    got = {r["url"]: r["plaintext"] for r in SI.latest_snapshot(spark, store).collect()}
    assert got == want
    assert {r["plaintext"] for r in SI.latest_snapshot(spark, store, as_of=0).select("plaintext").distinct().collect()} == {"a" * 500}


def test_ingest_of_crawl_rows_with_replayed_and_broken_batches(spark):
    import shutil

    from gleaner.sources import allowlist as AS
    from gleaner.streaming import ingest as SI

    root = tempfile.mkdtemp(prefix="gleaner-ingest-")
    al = AS.from_rows(spark, [dict(domain="tides.example", purpose="x", ttl_class="airline", added_at="2024-01-01")])
    page = "<html><head><title>Tides</title></head><body><article><p>" + "High water comes later every day. " * 20 + "</p></article></body></html>"
    t0 = dt.datetime(2024, 1, 1)

    def row(seq, url, body=page, status=200, error=None, final=None):
        return (url, status, "text/html", bytearray(body.encode()), error, final, seq, t0 + dt.timedelta(minutes=seq), "agent", f"task:{seq}")

    write = SI.make_batch_writer(f"{root}/s", f"{root}/p", rows_of=lambda b: SI.page_rows(b, al))
    b0 = spark.createDataFrame([row(1, "https://tides.example/a"), row(2, "https://tides.example/b", status=404),
                                row(3, "https://elsewhere.example/"), row(4, "https://tides.example/c", final="https://tides.example/a")],
                               SI.FETCHED)
    b1 = spark.createDataFrame([row(5, "https://tides.example/b"), row(6, "https://tides.example/a", error="AbortError")], SI.FETCHED)
    write(b0, 0)
    version = SI.provenance_log(spark, f"{root}/p", as_of=0)  # a reader that has begun
    write(b1, 1)
    os.remove(f"{root}/p/batch=1/_SUCCESS")  # as if the batch had died within the write
    shutil.rmtree(f"{root}/s/run=1")
    for _ in range(2):
        write(b1, 1)
    log = [(r.url, r.task_id) for r in SI.provenance_log(spark, f"{root}/p").collect()]
    assert sorted(log) == [("https://tides.example/a", "task:1"), ("https://tides.example/a", "task:4"), ("https://tides.example/b", "task:5")]
    assert version.count() == 2
    pages = {r.url: (r.low_signal, r.write_seq, r.ttl_seconds) for r in SI.latest_snapshot(spark, f"{root}/s").collect()}
    assert pages == {"https://tides.example/a": (True, 6, 3600), "https://tides.example/b": (False, 5, 3600)}


def test_null_source_ref_is_admitted(spark):
    root = tempfile.mkdtemp(prefix="gleaner-stream-")
    schema = "seq long, ts timestamp, source_ref string"
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, t0, None) for i in range(8)] + [(9, t0, "task:a")], schema).write.parquet(os.path.join(root, "in"))
    q = (SB.budget_stream(spark.readStream.schema(schema).parquet(os.path.join(root, "in"))).writeStream.format("parquet")
         .option("path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(root, "out")).collect()
    assert len(out) == 9 and all(r["budget_ok"] for r in out)


def _quota(spark, root, stream):
    from gleaner.session import start_stateful
    from gleaner.streaming import quota as SQ

    start_stateful(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return {r.seq: r.within for r in spark.read.schema(SQ.OUTPUT).parquet(f"{root}/out").collect()}


def test_daily_quota_across_batches_restarts_and_tasks(spark):
    import random

    from gleaner.streaming import quota as SQ

    root, schema = tempfile.mkdtemp(prefix="gleaner-quota-"), "seq long, ts timestamp"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i)) for i in range(600)]  # some 205 a day, three days
    want, used = {}, {}
    for seq, ts in rows:
        used[ts.date()] = used.get(ts.date(), 0) + 1
        want[seq] = used[ts.date()] <= 20
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    got = {}
    try:
        for n, part in enumerate((rows[:10], rows[10:300], rows[300:])):
            random.Random(n).shuffle(part)
            spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{root}/in/p={n}")
            stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
            got = _quota(spark, root, SQ.daily_cap(stream, 20))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_monthly_quota_of_null_times_and_no_rows(spark):
    from gleaner.streaming import quota as SQ

    root, schema = tempfile.mkdtemp(prefix="gleaner-quota-"), "seq long, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{root}/in")
    t0 = dt.datetime(2024, 1, 31)
    spark.createDataFrame([(1, None), (2, t0), (3, t0), (4, t0), (5, t0 + dt.timedelta(days=2))], schema).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    assert _quota(spark, root, SQ.monthly_spend(stream, "1", "2")) == {1: True, 2: True, 3: True, 4: False, 5: True}


def test_dedupe_stream_keeps_the_first_of_each_key(spark):
    from gleaner.streaming import quota as SQ

    root, schema = tempfile.mkdtemp(prefix="gleaner-dedupe-"), "seq long, ts timestamp, dedupe_key string"
    t0 = dt.datetime(2024, 1, 1)
    seen = []
    for n, rows in enumerate(([(1, 0, "a"), (2, 1, "b")], [(3, 2, "a"), (4, 3, "c")], [(5, 400, "a")], [(6, 401, "a"), (7, 402, "d")])):
        spark.createDataFrame([(s, t0 + dt.timedelta(hours=h), k) for s, h, k in rows], schema).write.parquet(f"{root}/in/p={n}")
        stream = SQ.dedupe(spark.readStream.schema(schema).parquet(f"{root}/in/*"), horizon="2 days")
        (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True).start().awaitTermination())
        seen = sorted(r.seq for r in spark.read.schema(schema).parquet(f"{root}/out").collect())
    assert seen == [1, 2, 4, 6, 7]  # 5 came before the watermark had passed the first a by two days


def test_ingest_does_not_move_rows_by_their_host(spark, tmp_path):
    from pyspark.sql import functions as F

    from gleaner.operators import allowlist as A
    from gleaner.sources import allowlist as AS
    from gleaner.streaming import ingest as SI

    al = AS.from_rows(spark, [dict(domain="tides.example", purpose="x", ttl_class="airline", added_at="2024-01-01")])
    url = F.concat(F.when(F.col("id") % 3 == 0, "https://elsewhere.example/").otherwise("https://www.tides.example/"), "id")
    null = lambda kind: F.lit(None).cast(kind)
    rows = spark.range(2000).select(
        url.alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.encode(F.concat(F.lit("<p>"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20)), "UTF-8").alias("body"),
        null("string").alias("error_name"), null("string").alias("final_url"), F.col("id").alias("crawl_seq"),
        F.timestamp_seconds("id").alias("fetched_at"), F.lit("a").alias("requesting_agent_id"), F.lit("t").alias("task_id"))
    rows.write.parquet(f"{tmp_path}/in")
    batch = spark.read.schema(SI.FETCHED).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    kept = A.host_entries(batch, "url", al).persist()
    try:
        assert kept.count() == 1
        pages = SI.page_rows(batch, al, entries=kept)
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [__gl_host" in plan and "SortMergeJoin [__gl_host" not in plan
        assert sorted(pages.collect()) == sorted(SI.page_rows(batch, al).collect()) and pages.count() == 1333
    finally:
        kept.unpersist()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_crawl_rows_without_redirect_do_not_meet_in_one_task(spark):
    from gleaner.sources import fixtures as FX

    SF_SMALL = "/root/testdata/sf0.001"

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(p) for p in FX.redirecting_crawl(spark, SF_SMALL).where("crawl_seq = 1").select("url", "final_url").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < sum(sizes) / 2


def _requests_and_crawl(spark):
    """Requests of urls with redirects, failures, two crawl rows, none, off the list; and the crawl rows."""
    from gleaner import schemas as S
    from gleaner.sources import allowlist as AS
    from gleaner.streaming import ingest as SI

    al = AS.from_rows(spark, [dict(domain="tides.example", purpose="x", ttl_class="airline", added_at="2024-01-01")])
    t0, site = dt.datetime(2024, 1, 1), "https://tides.example/"

    def html(word):
        body = f"High water comes {word} every day. " * 20
        return bytearray(f"<html><head><title>{word}</title></head><body><article><p>{body}</p></article></body></html>".encode())

    crawl = spark.createDataFrame([
        (site + "a", 200, "text/html", html("a"), None, None), (site + "b", 200, "text/html", html("b"), None, site + "a"),
        (site + "c", 404, "text/html", html("c"), None, ""), (site + "d", 200, "text/html", html("d1"), None, None),
        (site + "d", 200, "text/html", html("d2"), None, site + "a"), (site + "e", 0, None, None, "AbortError", site + "a"),
        ("https://elsewhere.example/", 200, "text/html", html("off"), None, site + "a"),
        (site + "unasked", 200, "text/html", html("u"), None, None)], S.CRAWL)
    names = ["a", "b", "a", "d", "c", "e", "a", "b", "d", "e", "nowhere", "a", "c"]
    urls = [site + n for n in names] + ["https://elsewhere.example/"] * 2 + [site + "a"] * 30 + ["https://elsewhere.example/"]
    asked = spark.createDataFrame([(u, seq, t0 + dt.timedelta(minutes=seq), "agent", f"task:{seq}") for seq, u in enumerate(urls)],
                                  SI.REQUESTED)
    return al, asked, crawl


def _heads_and_bodies(crawl):
    from pyspark.sql import functions as F

    rows = crawl.withColumn("fetch_id", F.xxhash64("url", "body"))
    return rows.drop("body"), rows.select("fetch_id", "url", "body")


def test_ingest_of_requests_equals_that_of_fetched_rows(spark, tmp_path, monkeypatch):
    from gleaner.streaming import ingest as SI

    monkeypatch.setattr(SI, "SHARE", 4)
    al, asked, crawl = _requests_and_crawl(spark)
    got = {}
    for way, rows_of, make in (("fetched", lambda b: SI.page_rows(b, al), lambda r: r.join(crawl, "url").select(*SI.FETCHED.fieldNames())),
                               ("asked", lambda b: SI.page_rows(b, al, crawl=_heads_and_bodies(crawl)), lambda r: r)):
        write = SI.make_batch_writer(f"{tmp_path}/{way}/s", f"{tmp_path}/{way}/p", rows_of=rows_of)
        for n, part in enumerate((asked.where("crawl_seq < 8"), asked.where("crawl_seq between 8 and 12"), asked.where("crawl_seq > 12"))):
            write(make(part), n)
        got[way] = [[sorted(map(repr, SI.latest_snapshot(spark, f"{tmp_path}/{way}/s", as_of=n).collect())) for n in range(3)],
                    sorted(map(repr, SI.provenance_log(spark, f"{tmp_path}/{way}/p").collect()))]
    assert got["asked"] == got["fetched"] and len(got["asked"][0][2]) == 4 and len(got["asked"][1]) == 40


def test_rows_of_a_hot_url_are_not_made_in_one_task(spark, monkeypatch):
    from gleaner.streaming import ingest as SI

    monkeypatch.setattr(SI, "SHARE", 4)
    _, asked, crawl = _requests_and_crawl(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = [[r.crawl_seq for r in p if r.url.endswith("/a")]
                 for p in SI.with_crawl(asked, *_heads_and_bodies(crawl), SI.shares(asked)).select("url", "crawl_seq").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(s for p in parts for s in p) == sorted(r.crawl_seq for r in asked.collect() if r.url.endswith("/a"))
    assert max(map(len, parts)) < 34


def test_crawl_ingest_does_not_store_a_body_per_request(spark):
    from gleaner.plans import q_streaming as QS
    from gleaner.streaming import ingest as SI

    root = QS._ingested(spark, "/root/testdata/sf0.001")
    asked = spark.read.parquet(f"{root}/in")
    assert asked.count() == QS.fetch_log(spark, "/root/testdata/sf0.001").count() > 0
    assert "body" not in asked.columns
    assert len(SI._complete(spark, f"{root}/provenance", "batch")) == 3


def test_bodies_of_hosts_off_the_list_are_not_joined(spark, monkeypatch):
    from gleaner.operators import allowlist as A
    from gleaner.streaming import ingest as SI

    al, asked, crawl = _requests_and_crawl(spark)
    joined, join = [], SI.with_crawl
    monkeypatch.setattr(SI, "with_crawl", lambda requests, heads, bodies, many: joined.append(bodies) or join(requests, heads, bodies, many))
    whole = sorted(map(repr, SI.page_rows(asked, al, crawl=_heads_and_bodies(crawl)).collect()))
    assert whole == sorted(map(repr, SI.page_rows(asked, al, entries=A.host_entries(asked, "url", al), crawl=_heads_and_bodies(crawl)).collect()))
    for table in joined:
        assert {r.url for r in table.collect()} == {f"https://tides.example/{n}" for n in ("a", "b", "c", "d", "e", "unasked")}


def test_crawl_rows_of_equal_pages_are_found_apart(spark, tmp_path):
    from gleaner import schemas as S
    from gleaner.sources import fixtures as FX
    from gleaner.streaming import ingest as SI

    schema = "page_id long, url string, html string"
    pages = [(i, f"https://example.com/{i}", f"<p>{i}</p>") for i in range(8)] + [(1, "https://example.com/1", "<p>1</p>"), (2, "https://example.com/2", "<p>two</p>"),
                                                                                 (None, "https://example.com/0", "<p>no number</p>")]
    spark.createDataFrame(pages, schema).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    crawl = FX.redirecting_crawl(spark, str(tmp_path)).where("crawl_seq = 1").select(*S.CRAWL.fieldNames())
    asked = crawl.select("url").distinct().selectExpr("url", "xxhash64(url) as crawl_seq")
    got = SI.with_crawl(asked, *FX.heads_and_bodies(spark, str(tmp_path)), SI.shares(asked)).drop("crawl_seq")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, crawl.collect()))
