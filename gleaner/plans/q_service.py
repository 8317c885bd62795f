"""Registered queries: the whole service over the request lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..session import materialize, scratch_path
from ..sources import fixtures as FX
from ..sources import requests as RS
from . import q_fetch, q_requests, q_search, service
from .q_store import snapshot
from .registry import ORACLES, register


def payloads(spark, sf_dir):
    """Saved upstream answers for every search request of the log."""
    r = FX.requests(spark, sf_dir).filter(F.col("contract_id") == S.CONTRACT_SEARCH)
    return r.select("seq", F.expr(q_search.STATUS_EXPR).alias("http_status"), F.expr(q_search.PAYLOAD_EXPR).alias("payload_json"))


def responses(spark, sf_dir):
    return service.serve(FX.request_lines(spark, sf_dir), FX.allowlist(spark), snapshot(spark, sf_dir),
                         FX.crawl(spark, sf_dir), payloads(spark, sf_dir))


def _told(lines, key):
    """Every line's code, and what its response says."""
    told = F.from_json("response", "ok boolean, code string, message string, reason string, trace_id string")
    return lines.withColumn("r", told).select(
        key, "code", F.col("r.ok").alias("ok"), F.col("r.code").alias("told"),
        F.coalesce("r.message", "r.reason").alias("message"), F.col("r.trace_id").alias("trace_id"))


@register("service_responses")
def service_responses(spark, sf_dir):
    return _told(responses(spark, sf_dir), "seq")


@register("service_code_counts")
def service_code_counts(spark, sf_dir):
    return responses(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@register("service_file_responses")
def service_file_responses(spark, sf_dir):
    """Request files in, response lines out: the lines get their numbers and times from the files, upstream answers are
    saved under the line's number."""
    lines = materialize(RS.numbered_lines(RS.read_lines(spark, q_requests.text_dir(spark, sf_dir))), "numbered-lines")
    asked = FX.numbered_requests(spark, sf_dir).filter(F.col("contract_id") == S.CONTRACT_SEARCH)
    saved = asked.select(F.col("number").alias("seq"), "url").select(
        "seq", F.expr(q_search.STATUS_EXPR).alias("http_status"), F.expr(q_search.PAYLOAD_EXPR).alias("payload_json"))
    served = service.serve(lines, FX.allowlist(spark), snapshot(spark, sf_dir), FX.crawl(spark, sf_dir), saved)
    path = scratch_path(spark, f"responses-{uuid.uuid4().hex}")
    RS.write_lines(served.select(F.to_json(F.struct("seq", "code", "response")).alias("value")), path)
    out = spark.read.text(path).select(F.from_json("value", "seq long, code string, response string").alias("x")).select("x.*")
    return _told(out.withColumnRenamed("seq", "line"), "line")


_js = q_requests._js


def _admitted_sql(lines_sql: str) -> str:
    return lines_sql + ", " + q_requests._ADMIT_SQL + f""", adml as (select vv.seq, vv.ts, adm.code, vv.errors, vv.parse_error,
 {_js('contract_id')} as contract_id, {_js('url')} as url, {_js('caller_agent_id')} as caller_agent_id,
 {_js('source_ref')} as source_ref, {_js('freshness')} as freshness, {_js('trace_id')} as trace_id, {_js('query')} as query,
 cast(try_cast(json_extract(jv, '$.top_n') as double) as int) as top_n,
 json_extract_string(jv, '$.site_filter[*]') as sites, json_type(jv, '$.site_filter') as sites_type from vv join adm on adm.seq = vv.seq)"""


def _told_sql(lines_sql: str, url_join: str) -> str:
    """Every line's code and what its response says; ``url_join`` finds the log's row of a line as ``q``."""
    admitted = _admitted_sql(lines_sql)
    fetch = q_fetch.pipe_sql(FX.CRAWL_SQL, q_fetch.BY_URL_SQL, admitted,
                             "from adml where code = 'admitted' and contract_id = 'web.fetch.v1'")
    search = q_search.search_sql(admitted, f"""select a.seq, a.ts as now, a.query as query_raw, a.top_n,
 a.freshness as freshness_raw, case when a.sites_type = 'ARRAY' then a.sites end as site_filter, a.caller_agent_id, a.source_ref,
 a.trace_id, q.url from adml a {url_join} where a.code = 'admitted' and a.contract_id = 'web.search.v1'""")
    return f"""select seq, code, code = 'ok' as ok, case when code <> 'ok' then code end as told, message, trace_id from (
 select * from ({FX.with_ctes(FX.REQ_SQL, admitted)} select seq, code, case when parse_error = 'too_large' then 'request line too large'
   when code = 'bad_query' then 'invalid JSON' when code = 'validation_failed' then errors
   else concat('source_ref ', source_ref, ' exceeded WEB_OPS_PER_TASK ({S.OPS_PER_TASK})') end as message,
   case when code = 'budget_exhausted' then trace_id end as trace_id from adml where code <> 'admitted')
 union all select * from ({fetch} select seq, case when status = 'off_allowlist' then 'not_allowlisted'
   when status = 'low_signal' then 'low_signal' else 'ok' end as code, reason as message, trace_id from o)
 union all select * from ({search} select seq, code, message, trace_id from o))"""


_TOLD = _told_sql(FX.LINES_SQL, "join req q on q.seq = a.seq")
ORACLES["service_responses"] = f"select seq, code, ok, told, message, trace_id from ({_TOLD})"
ORACLES["service_code_counts"] = f"select code, count(*) as n from ({_TOLD}) group by code"
ORACLES["service_file_responses"] = "select seq as line, code, ok, told, message, trace_id from (" + _told_sql(
    q_requests.FILE_LINES_SQL, "join numbers m on m.seq = a.seq join req q on q.seq = m.log_seq") + ")"
