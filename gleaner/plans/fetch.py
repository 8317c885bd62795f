"""Fetch pipeline (O39) with response routing (O14) and the response sink.

gate (allowlist) -> store lookup with freshness gate -> [misses] crawl triage -> extraction -> quality -> fingerprint ->
page upsert + provenance -> response.

Requests of one batch are applied in arrival order: a miss fetches, and what it fetched becomes the store row of the
url where the fetch ended, which later requests of that url see (``replay.store_replay``, seeded with the snapshot's
``fetched_at``). After a redirect that is another url than the requested one, so a second request of the same url misses
again, and one of the final url hits. ``now`` is the request's own timestamp column; the wall clock is never read.

Of several crawl rows of a url one counts (``crawl.one_per_url``), of several store rows the last written.

Outputs (``FetchResult``): ``outcomes`` (one row per request, without page text), ``provenance`` (rows to append),
``writes`` (page rows to upsert, the last per url) and ``snapshot`` (the upserted store). The replayed requests and the
extracted pages are written once under ``spark.checkpoint.dir``; page text is joined where an output holds it only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions import urls as U
from ..operators import allowlist as A
from ..operators import crawl as C
from ..operators import extract as XT
from ..operators import replay as RP
from ..operators import store as ST
from ..session import materialize


@dataclass
class FetchResult:
    outcomes: DataFrame
    provenance: DataFrame
    writes: DataFrame
    snapshot: DataFrame
    stored: DataFrame  # url, plaintext of the store rows that the batch asked for
    fetched: DataFrame  # url, plaintext of the pages that it fetched


def crawl_pages(crawl: DataFrame, max_bytes=S.MAX_BODY_BYTES, keep: tuple | list = ()) -> DataFrame:
    """Per crawl row: the page row a fresh fetch would write (triage -> extract -> quality -> fingerprint), and the columns
    to ``keep``."""
    t = C.triage(crawl, max_bytes=max_bytes).withColumnRenamed("reason", "t_reason")
    x = XT.extract(t.select("url", "doc_url", "doc_origin", "t_reason", "byte_size", "body_text", *keep), "body_text")
    low = F.col("t_reason").isNotNull() | F.col("low_signal")
    return x.select(
        F.col("url").alias("k_url"), F.col("doc_url").alias("k_doc_url"), F.col("doc_origin").alias("k_origin"),
        low.alias("k_low"), F.coalesce("t_reason", "reason").alias("k_reason"),
        F.when(F.col("t_reason").isNotNull(), F.lit(None)).otherwise(F.col("title")).alias("k_title"),
        F.when(low, F.lit("")).otherwise(F.col("plaintext")).alias("k_plaintext"),
        F.when(low, X.low_signal_sha(F.col("doc_url"))).otherwise(X.sha256_hex("plaintext")).alias("k_sha"),
        F.col("byte_size").alias("k_byte_size"), *keep)


def fetch_pipeline(requests: DataFrame, allowlist: DataFrame, snapshot: DataFrame, crawl: DataFrame,
                   max_bytes=S.MAX_BODY_BYTES) -> FetchResult:
    """requests: ``seq, now (timestamp), url, requesting_agent_id, task_id, bypass_cache, trace_id``;
    snapshot: ``schemas.FETCHED_PAGES`` (+ optional ``write_seq``); crawl: ``schemas.CRAWL`` (+ optional
    ``crawl_seq``)."""
    if "write_seq" not in snapshot.columns:
        snapshot = snapshot.withColumn("write_seq", F.lit(-1).cast("long"))
    # the gated request batch feeds the replay, two semi-joins and the main join
    r = materialize(A.lookup(requests, "url", allowlist), "fetch-requests")
    on = r.filter(F.col("al_domain").isNotNull())
    # only the batch's requested urls are ever read from the store or the crawl, and triage and extraction run once
    # for each of them
    wanted = on.select("url").distinct()
    store = ST.last_written(snapshot.join(wanted, "url", "left_semi"))
    pages = materialize(crawl_pages(C.one_per_url(crawl.join(wanted, "url", "left_semi")), max_bytes), "fetched-pages")
    asked = (on.join(pages.select(F.col("k_url").alias("url"), F.col("k_doc_url").alias("target")), "url", "left")
             .select("url", F.unix_micros(F.col("now").cast("timestamp")).alias("t_us"), "seq",
                     F.coalesce("bypass_cache", F.lit(False)).alias("realtime"), F.col("al_ttl_seconds").alias("ttl"),
                     F.coalesce("target", "url").alias("target")))
    replay = RP.store_replay(
        asked, store.select("url", F.unix_micros(X.parse_iso(F.col("fetched_at"))).alias("t_us"))
        .filter(F.col("t_us").isNotNull()))

    # a request is served by the store's own row, or by the page of the url whose fetch wrote the row that it sees
    off, seed = F.col("al_domain").isNull(), F.coalesce("from_seed", F.lit(False))
    r = (r.join(replay, "seq", "left")
         .select("*", F.coalesce("hit", F.lit(False)).alias("was_hit"), seed.alias("seed"),
                 F.when(~off & ~seed, F.coalesce("ref_writer", "url")).alias("source")))
    snap = store.select(*[F.col(c).alias("s_" + c) for c in ST.PAGE_COLS if c != "plaintext"])
    j = (r.join(snap, F.col("seed") & (F.col("url") == F.col("s_url")), "left")
         .join(pages.drop("k_plaintext"), F.col("source") == F.col("k_url"), "left"))
    # a url with no crawl row behaves like a transport error
    j = j.withColumns({
        "doc_low": F.when(F.col("seed"), F.col("s_low_signal")).otherwise(F.coalesce("k_low", F.lit(True))),
        "doc_reason": F.when(F.col("k_url").isNull(), F.lit("transport_error")).otherwise(F.col("k_reason")),
        "doc_url": F.when(off | F.col("was_hit"), F.col("url")).otherwise(F.coalesce("k_doc_url", "url")),
        "now_iso": X.iso_ms("now")})
    status = (F.when(off, F.lit("off_allowlist")).when(F.col("doc_low"), F.lit("low_signal"))
              .when(F.col("was_hit"), F.lit("cache_hit")).otherwise(F.lit("ok")))
    reason = F.when(~off & F.col("doc_low"), F.when(F.col("was_hit"), F.lit("cached_low_signal")).otherwise(F.col("doc_reason")))
    origin = F.when(F.col("seed"), F.col("s_origin")).otherwise(F.coalesce("k_origin", U.origin(F.col("doc_url"))))
    sha = F.when(F.col("seed"), F.col("s_content_sha256")).otherwise(F.coalesce("k_sha", X.low_signal_sha(F.col("doc_url"))))
    fetched = (F.when(F.col("seed"), F.col("s_fetched_at"))
               .when(F.col("was_hit"), X.iso_ms(F.timestamp_micros("ref_us"))).otherwise(F.col("now_iso")))
    outcomes = j.select(
        "seq", "now", "trace_id", "requesting_agent_id", "task_id", F.col("url").alias("requested_url"),
        F.col("al_ttl_seconds").alias("ttl_seconds"), F.col("was_hit").alias("hit"), F.col("seed").alias("from_seed"),
        status.alias("status"), reason.alias("reason"), F.col("doc_url").alias("url"),
        F.when(~off, origin).alias("origin"),
        F.when(F.col("seed"), F.col("s_title")).otherwise(F.col("k_title")).alias("title"),
        sha.alias("content_sha256"),
        F.when(F.col("seed"), F.col("s_byte_size")).otherwise(F.coalesce("k_byte_size", F.lit(0).cast("long"))).alias("byte_size"),
        fetched.alias("fetched_at"), "source")
    outcomes = materialize(outcomes.withColumn("ok", F.col("status").isin("ok", "cache_hit")).withColumn(
        "code", F.when(F.col("status") == "off_allowlist", F.lit("not_allowlisted"))
        .when(F.col("status") == "low_signal", F.lit("low_signal")).otherwise(F.lit("ok"))), "fetch-outcomes")

    now_iso = X.iso_ms("now")
    prov = outcomes.filter(F.col("hit") | (F.col("status") == "ok")).select(
        "url", "origin", "content_sha256", now_iso.alias("fetched_at"), "requesting_agent_id", "task_id",
        F.lit("fetch").alias("kind"), F.col("seq").alias("request_seq"))
    missed = outcomes.filter((F.col("status") != "off_allowlist") & ~F.col("hit")).select(
        "url", "origin", "content_sha256", "title", now_iso.alias("fetched_at"), "ttl_seconds",
        (F.col("status") == "low_signal").alias("low_signal"), "byte_size", F.col("seq").cast("long").alias("write_seq"), "source")
    fetched_text = pages.where("k_plaintext <> ''").select(F.col("k_url").alias("source"), F.col("k_plaintext").alias("plaintext"))
    writes = (ST.last_written(missed).join(fetched_text, "source", "left")
              .select(*[F.coalesce(c, F.lit("")).alias(c) if c == "plaintext" else c for c in ST.PAGE_COLS], "write_seq"))
    return FetchResult(outcomes, prov, writes, ST.upsert(snapshot.select(*ST.PAGE_COLS, "write_seq"), writes),
                       store.select("url", "plaintext"), fetched_text)


def responses(result: FetchResult) -> DataFrame:
    """One JSON response line per request (O7): success fields for ok/cache_hit, code/reason otherwise.
    Success lines keep NULL fields (a page without title sends ``"title":null``); failures omit them."""
    served = F.col("ok") & F.col("from_seed")
    o = (result.outcomes
         .withColumns({"s_url": F.when(served, F.col("requested_url")), "f_url": F.when(F.col("ok") & ~F.col("from_seed"), F.col("source"))})
         .join(result.stored.select(F.col("url").alias("s_url"), F.col("plaintext").alias("s_text")), "s_url", "left")
         .join(result.fetched.select(F.col("source").alias("f_url"), F.col("plaintext").alias("f_text")), "f_url", "left")
         .withColumn("plaintext", F.coalesce(F.when(served, F.col("s_text")), "f_text", F.lit(""))))
    success = F.struct(F.lit(True).alias("ok"), F.lit(S.CONTRACT_FETCH).alias("contract_id"), "trace_id", "status",
                       "url", "origin", "title", "plaintext", "content_sha256", "byte_size", "fetched_at")
    failure = F.struct(F.lit(False).alias("ok"), "code", "reason", "url", "origin", "trace_id")
    return o.select("seq", F.when(F.col("ok"), F.to_json(success, {"ignoreNullFields": "false"})).otherwise(F.to_json(failure)).alias("response"))


def write_responses(result: FetchResult, path: str) -> None:
    """Response sink: NDJSON text files."""
    responses(result).select("response").write.mode("overwrite").text(path)
