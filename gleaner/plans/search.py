"""Search pipeline (O40): trim + defaults -> site_filter check -> saved upstream payload -> normalise ->
narrow -> top-N -> origin; one provenance row per successful search, even with zero results.

Codes: ``bad_query`` (empty query after trim, or a site_filter host off the allowlist), ``upstream_error``
(non-2xx status or invalid JSON payload), ``handler_error`` (a payload the handler cannot walk), else ok. Every step is a narrow column expression, a broadcast
allowlist join, or a join on the request key; the top-N is a rank filter per request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions import urls as U
from ..operators import search as SR
from ..session import materialize


@dataclass
class SearchResult:
    outcomes: DataFrame
    results: DataFrame
    provenance: DataFrame


def search_pipeline(requests: DataFrame, payloads: DataFrame, allowlist: DataFrame, key: str = "seq") -> SearchResult:
    """requests: ``seq, now, query, top_n, freshness, site_filter, caller_agent_id, source_ref, trace_id``
    (validated envelopes); payloads: ``seq, http_status, payload_json``."""
    q = X.js_trim(F.col("query"))
    r = (requests
         .withColumn("query", F.coalesce(q, F.lit("")))
         .withColumn("top_n", F.coalesce(F.col("top_n").cast("int"), F.lit(S.DEFAULT_TOP_N)))
         .withColumn("freshness", F.coalesce("freshness", F.lit(S.DEFAULT_SEARCH_FRESHNESS))))
    off = SR.site_filter_offender(r, allowlist, key)
    # each payload is parsed once; what the parse gives is stored with the request
    p = SR.parse_payloads(payloads.select(key, "http_status", "payload_json")).select(
        key, "http_status", "payload", SR.upstream_error().alias("upstream_error"), SR.handler_error().alias("handler_error"))
    r = r.join(off, key, "left").join(p, key, "left")
    message = (F.when(F.col("query") == "", F.lit("query is empty"))
               .when(F.col("offender").isNotNull(),
                     F.concat(F.lit("site_filter hostname not on allowlist: "), F.col("offender")))
               .when(F.col("http_status").isNull(), F.lit("upstream_no_response"))
               .when(F.col("upstream_error").isNotNull(), F.col("upstream_error"))
               .when(F.col("handler_error"), F.lit(S.HANDLER_ERROR_MESSAGE)))
    code = (F.when((F.col("query") == "") | F.col("offender").isNotNull(), F.lit("bad_query"))
            .when(F.col("http_status").isNull() | F.col("upstream_error").isNotNull(), F.lit("upstream_error"))
            .when(F.col("handler_error"), F.lit("handler_error"))
            .otherwise(F.lit("ok")))
    # the decided request table feeds four branches (scan, narrow, top-N, provenance): write it once under
    # spark.checkpoint.dir instead of recomputing its lineage per branch
    r = materialize(r.withColumn("code", code).withColumn("message", message).drop("offender", "http_status", "handler_error"),
                    "search-requests")
    good = r.filter(F.col("code") == "ok")
    # every result carries what its request asked for; the upstream is asked for top_n results, so entries past that
    # count were never returned
    raw = SR.scan_results(good, key, carry=("top_n", "site_filter")).filter(F.col("rank") < F.col("top_n"))
    top = SR.top_n(SR.narrowed(SR.normalise(raw, allowlist)), "top_n", key)
    results = top.select(key, "result_rank", "title", "url", "snippet",
                         U.origin("url").alias("origin"))
    counts = results.groupBy(key).agg(F.count(F.lit(1)).alias("n_results"))
    outcomes = (r.join(counts, key, "left")
                .withColumn("n_results", F.when(F.col("code") == "ok", F.coalesce("n_results", F.lit(0)))
                            .cast("long"))
                .select(key, "trace_id", "query", "top_n", "freshness", "code", "message", "n_results"))
    prov = good.select(
        SR.search_url(F.col("query"), F.col("top_n"), F.col("freshness")).alias("url"),
        F.lit(S.SEARCH_URL_SCHEME).alias("origin"),
        SR.search_sha(F.col("query"), F.col("top_n"), F.col("freshness")).alias("content_sha256"),
        X.iso_ms("now").alias("fetched_at"), F.col("caller_agent_id").alias("requesting_agent_id"),
        F.col("source_ref").alias("task_id"), F.lit("search").alias("kind"), F.col(key).alias("request_seq"))
    return SearchResult(outcomes, results, prov)


def responses(result: SearchResult, key: str = "seq") -> DataFrame:
    """One JSON response line per search request (O7): ``ok, contract_id, trace_id, query, top_n, freshness,
    results[]`` for successes (results in rank order, at most ``top_n``), ``ok, code, message, trace_id``
    otherwise. The per-request result list is bounded by ``top_n`` (<= 20)."""
    items = (result.results
             .groupBy(key)
             .agg(F.array_sort(F.collect_list(F.struct("result_rank", "title", "url", "snippet", "origin")))
                  .alias("items")))
    o = result.outcomes.join(items, key, "left")
    res = F.coalesce(
        F.transform("items", lambda x: F.struct(x.title.alias("title"), x.url.alias("url"),
                                                x.snippet.alias("snippet"), x.origin.alias("origin"))),
        F.array().cast("array<struct<title:string,url:string,snippet:string,origin:string>>"))
    success = F.struct(F.lit(True).alias("ok"), F.lit(S.CONTRACT_SEARCH).alias("contract_id"), "trace_id", "query",
                       "top_n", "freshness", res.alias("results"))
    failure = F.struct(F.lit(False).alias("ok"), "code", "message", "trace_id")
    return o.select(key, F.when(F.col("code") == "ok", F.to_json(success)).otherwise(F.to_json(failure))
                    .alias("response"))
