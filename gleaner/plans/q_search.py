"""Registered queries: payload scan (O3), normalise (O11), site_filter check (O18) and narrowing (O19),
top-N (O29), search pipeline outcomes/results (O40) and search provenance (O35 + O33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import search as SR
from ..sources import fixtures as FX
from . import search as SP
from . import sqltext as Q
from .q_citations import js_trim_sql
from .q_requests import _BUDGET_SQL, budgeted_requests
from .q_store import iso_sql
from .registry import ORACLES, register

# Fixed derivation rules shared by both engines (search request variants and saved upstream payloads).
QUERY_EXPR = "case when seq % 13 = 2 then '  ' when seq % 17 = 4 then 'café (menu)*!~' else query end"
FRESH_EXPR = "case when seq % 5 = 0 then null else 'week' end"
STATUS_EXPR = "case when seq % 29 = 1 then 503 else 200 end"
PAYLOAD_EXPR = """case when seq % 31 = 2 then 'not json' when seq % 23 = 4 then '{}' when seq % 37 = 5 then 'null'
 when seq % 41 = 6 then '{"web": {"results": 5}}' when seq % 43 = 8 then '{"web": {"results": [null]}}'
 when seq % 47 = 9 then '{} {}' when seq % 53 = 10 then '{"web": null}' when seq % 59 = 11 then '{"web": {"results": "text"}}' else concat('{"web": {"results": [',
 '{"title": "T0", "url": "', url, '", "description": "first"}, ',
 '{"title": "T1", "url": "https://www.example.com/a/', cast(seq as string), '", "description": "second"}, ',
 '{"title": 5, "url": "https://example.org/x", "description": "bad title"}, ',
 '{"title": "T3", "url": "https://example.net/y", "description": "off list"}, ',
 '{"title": "T4", "url": "https://spam-farm.example.org/p', cast(seq as string), '", "description": "nested"}, ',
 '{"title": "T5", "url": "https://example.com/z"}, ',
 '{"title": "T6", "url": "https://example.org/q', cast(seq as string), '", "description": "last"}',
 ']}}') end"""


def search_requests(spark, sf_dir):
    b = budgeted_requests(spark, sf_dir).filter(F.col("budget_ok") & (F.col("contract_id") == S.CONTRACT_SEARCH))
    return b.select("seq", F.col("ts").alias("now"), F.expr(QUERY_EXPR).alias("query"), "top_n",
                    F.expr(FRESH_EXPR).alias("freshness"), FX.site_filter().alias("site_filter"),
                    "caller_agent_id", "source_ref", "trace_id", "url")


def payloads(spark, sf_dir):
    r = search_requests(spark, sf_dir)
    return r.select("seq", F.expr(STATUS_EXPR).alias("http_status"), F.expr(PAYLOAD_EXPR).alias("payload_json"))


def run(spark, sf_dir):
    r = search_requests(spark, sf_dir)
    pays = r.select("seq", F.expr(STATUS_EXPR).alias("http_status"), F.expr(PAYLOAD_EXPR).alias("payload_json"))
    return SP.search_pipeline(r.drop("url"), pays, FX.allowlist(spark))


def _has_sql(u: str) -> str:
    h = Q.host(u)
    return f"exists (select 1 from al where {h} = al.domain or ends_with({h}, '.' || al.domain))"


_FIELD = "case when json_type(e, '$.{f}') = 'VARCHAR' then json_extract_string(e, '$.{f}') end"
_ENC = "replace(replace(replace(replace(replace(url_encode(query), '%28', '('), '%29', ')'), '%2A', '*'), '%21', '!'), '%27', '''')"

HANDLER_SQL = """(json_type(p.payload_json) = 'NULL' or coalesce(json_type(p.payload_json, '$.web.results'), 'NULL')
  not in ('NULL', 'ARRAY', 'VARCHAR') or list_contains(json_extract_string(p.payload_json, '$.web.results[*]'), 'null')
  or len(list_filter(json_extract(p.payload_json, '$.web.results[*]'), lambda x: x is null or json_type(x) = 'NULL')) > 0)"""

ASKED_SQL = f"""select seq, ts as now, {QUERY_EXPR} as query_raw, top_n, {FRESH_EXPR} as freshness_raw,
  {FX.SITE_FILTER_SQL} as site_filter, caller_agent_id, source_ref, trace_id, url from bud
  where budget_ok and contract_id = 'web.search.v1'"""


def search_sql(budget_sql: str = _BUDGET_SQL, asked_sql: str = ASKED_SQL) -> str:
    """The search pipeline up to ``o`` (requests) and ``top`` (results). ``budget_sql``: CTEs that admit requests;
    ``asked_sql``: the search requests among them."""
    return FX.with_ctes(FX.AL_SQL, FX.REQ_SQL, budget_sql) + f""",
sreq as ({asked_sql}),
pay as (select seq, {STATUS_EXPR} as http_status, {PAYLOAD_EXPR.replace('as string', 'as varchar')} as payload_json from sreq),
r as (select seq, now, {js_trim_sql('query_raw')} as query, coalesce(top_n, 5) as top_n,
  coalesce(freshness_raw, 'any') as freshness, site_filter, caller_agent_id, source_ref, trace_id from sreq),
sfh as (select seq, unnest(site_filter) as host, unnest(range(len(site_filter))) as pos from r where site_filter is not null),
off as (select seq, arg_min(host, pos) as offender from sfh where not {_has_sql("('https://' || host || '/')")} group by seq),
o as (select r.*, off.offender, p.http_status, p.payload_json,
  case when r.query = '' or off.offender is not null then 'bad_query'
       when p.http_status is null or p.http_status < 200 or p.http_status >= 300 or not json_valid(p.payload_json)
       then 'upstream_error' when {HANDLER_SQL} then 'handler_error' else 'ok' end as code,
  case when r.query = '' then 'query is empty'
       when off.offender is not null then 'site_filter hostname not on allowlist: ' || off.offender
       when p.http_status is null then 'upstream_no_response'
       when p.http_status < 200 or p.http_status >= 300 then 'brave_search: brave_search_http_' || cast(p.http_status as varchar)
       when not json_valid(p.payload_json) then 'brave_search: brave_search_invalid_json'
       when {HANDLER_SQL} then 'handler exception (logged)' end as message
  from r left join off on off.seq = r.seq left join pay p on p.seq = r.seq),
scan as (select seq, pos as rank, e from (select seq, unnest(items) as e, unnest(range(len(items))) as pos from
  (select seq, json_extract(case when json_valid(payload_json) then payload_json end, '$.web.results[*]') as items from pay))),
fields as (select seq, cast(rank as integer) as rank, {_FIELD.format(f='title')} as title, {_FIELD.format(f='url')} as url,
  {_FIELD.format(f='description')} as description from scan),
raw as (select f.* from fields f join o on o.seq = f.seq where o.code = 'ok' and f.rank < o.top_n),
norm as (select seq, rank, title, url, description as snippet from raw
  where title is not null and url is not null and description is not null and {_has_sql('url')}),
narrowed as (select n.* from norm n join o on o.seq = n.seq
  where o.site_filter is null or ({Q.host('n.url')} is not null and list_contains(o.site_filter, {Q.host('n.url')}))),
top as (select * from (select n.*, row_number() over (partition by n.seq order by n.rank) as result_rank, o.top_n as tn
  from narrowed n join o on o.seq = n.seq) where result_rank <= tn)
"""


SEARCH_SQL = search_sql()


@register("search_results_scan")
def search_results_scan(spark, sf_dir):
    return SR.scan_results(SR.parse_payloads(payloads(spark, sf_dir)))


ORACLES["search_results_scan"] = SEARCH_SQL + """select seq, rank, title, url, description,
 (title is not null and url is not null and description is not null) as is_wellformed from fields"""


@register("search_normalise")
def search_normalise(spark, sf_dir):
    return SR.normalise(SR.scan_results(SR.parse_payloads(payloads(spark, sf_dir))), FX.allowlist(spark))


ORACLES["search_normalise"] = SEARCH_SQL + f"""select seq, rank, title, url, description as snippet from fields
 where title is not null and url is not null and description is not null and {_has_sql('url')}"""


@register("site_filter_check")
def site_filter_check(spark, sf_dir):
    return SR.site_filter_offender(search_requests(spark, sf_dir), FX.allowlist(spark))


ORACLES["site_filter_check"] = SEARCH_SQL + "select seq, offender from off"


@register("search_site_filter")
def search_site_filter(spark, sf_dir):
    req = search_requests(spark, sf_dir)
    norm = SR.normalise(SR.scan_results(SR.parse_payloads(payloads(spark, sf_dir))), FX.allowlist(spark))
    return SR.narrow(norm, req).select("seq", "rank", "url")


ORACLES["search_site_filter"] = SEARCH_SQL + f"""select n.seq, n.rank, n.url from (select * from fields
 where title is not null and url is not null and description is not null and {_has_sql('url')}) n join r on r.seq = n.seq
 where r.site_filter is null or ({Q.host('n.url')} is not null and list_contains(r.site_filter, {Q.host('n.url')}))"""


@register("search_topn")
def search_topn(spark, sf_dir):
    return run(spark, sf_dir).results.select("seq", F.col("result_rank").cast("long").alias("result_rank"), "url")


ORACLES["search_topn"] = SEARCH_SQL + "select seq, result_rank, url from top"


@register("search_pipeline")
def search_pipeline(spark, sf_dir):
    return run(spark, sf_dir).outcomes


ORACLES["search_pipeline"] = SEARCH_SQL + """select o.seq, o.trace_id, o.query, o.top_n, o.freshness, o.code, o.message,
 case when o.code = 'ok' then coalesce(c.n, 0) end as n_results from o
 left join (select seq, count(*) as n from top group by seq) c on c.seq = o.seq"""


@register("search_results")
def search_results(spark, sf_dir):
    return run(spark, sf_dir).results.withColumn("result_rank", F.col("result_rank").cast("long"))


ORACLES["search_results"] = SEARCH_SQL + f"""select seq, result_rank, title, url, snippet, {Q.origin('url')} as origin from top"""


@register("search_provenance")
def search_provenance(spark, sf_dir):
    return run(spark, sf_dir).provenance


ORACLES["search_provenance"] = SEARCH_SQL + f"""select 'brave-search://' || {_ENC} || '?top_n=' || cast(top_n as varchar)
 || '&freshness=' || freshness as url, 'brave-search://' as origin,
 sha256(concat_ws(':', query, cast(top_n as varchar), freshness)) as content_sha256, {iso_sql('now')} as fetched_at,
 caller_agent_id as requesting_agent_id, source_ref as task_id, 'search' as kind, seq as request_seq from o where code = 'ok'"""


@register("search_responses")
def search_responses(spark, sf_dir):
    """The response lines, read back: every field, which keys the line has, and the results as one text."""
    lines = SP.responses(run(spark, sf_dir))
    fields = F.from_json("response", "ok boolean, contract_id string, trace_id string, query string, top_n int, "
                         "freshness string, code string, message string, "
                         "results array<struct<title:string,url:string,snippet:string,origin:string>>")
    r = lines.withColumn("r", fields).withColumn("keys", F.array_join(F.json_object_keys("response"), ",")).select("seq", "keys", "r.*")
    told = F.array_join(F.transform("results", lambda x: F.concat_ws("|", x.title, x.url, x.snippet, x.origin)), chr(10))
    return r.withColumn("n_results", F.size("results").cast("long")).withColumn("results", told)


ORACLES["search_responses"] = SEARCH_SQL + f""", res as (select seq, count(*) as n,
 string_agg(concat_ws('|', title, url, snippet, {Q.origin('url')}), chr(10) order by result_rank) as told from top group by seq)
select o.seq, case when o.code = 'ok' then 'ok,contract_id,trace_id,query,top_n,freshness,results'
  else 'ok,code,message,trace_id' end as keys, o.code = 'ok' as ok,
 case when o.code = 'ok' then 'web.search.v1' end as contract_id, o.trace_id, case when o.code = 'ok' then o.query end as query,
 case when o.code = 'ok' then o.top_n end as top_n, case when o.code = 'ok' then o.freshness end as freshness,
 case when o.code <> 'ok' then o.code end as code, case when o.code <> 'ok' then o.message end as message,
 case when o.code = 'ok' then coalesce(res.told, '') end as results,
 case when o.code = 'ok' then coalesce(res.n, 0) end as n_results from o left join res on res.seq = o.seq"""
