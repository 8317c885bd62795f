"""Registered queries: request parsing (O1), contract validation (O8), per-task budget (O27), admission (O42),
op counts (O26), declared daily cap (D4), monthly spend (D5) and dedupe keys (D1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import budgets as B
from ..operators import requests as R
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import requests as RS
from . import service
from . import sqltext as Q
from .registry import register

WS = X.WS


def parsed_lines(spark, sf_dir):
    return R.parse_lines(FX.request_lines(spark, sf_dir))


def validated(spark, sf_dir):
    return R.validate(parsed_lines(spark, sf_dir))


def admitted_lines(spark, sf_dir):
    """Admission of the request lines."""
    return service.admit(FX.request_lines(spark, sf_dir), [])


# ---------------------------------------------------------------------------------------------------
# SQL twin of parse + validate
# ---------------------------------------------------------------------------------------------------
def _jt(f):
    return f"json_type(jv, '$.{f}')"


def _js(f):
    return f"json_extract_string(jv, '$.{f}')"


def _jn(f):
    return f"try_cast(json_extract(jv, '$.{f}') as double)"


_NUM = "('BIGINT','UBIGINT','DOUBLE')"


def _rules_sql():
    r = []
    for f in S.COMMON_FIELDS[1:]:
        r.append(f"case when {_jt(f)} is null then 'required:{f}' end")
    r.append(f"case when is_search and {_jt('query')} is null then 'required:query' end")
    r.append(f"case when is_fetch and {_jt('url')} is null then 'required:url' end")
    for f in S.COMMON_FIELDS[1:]:
        r.append(f"case when {_jt(f)} is not null and {_jt(f)} <> 'VARCHAR' then 'type:{f}' end")
    r.append(f"case when {_jt('trace_id')} = 'VARCHAR' and not regexp_matches({_js('trace_id')}, {Q.q(S.TRACE_ID_PATTERN)}) then 'pattern:trace_id' end")
    r.append(f"case when is_search and {_jt('query')} is not null and {_jt('query')} <> 'VARCHAR' then 'type:query' end")
    r.append(f"case when is_search and {_jt('query')} = 'VARCHAR' and (length({_js('query')}) < {S.QUERY_MIN_LEN} or length({_js('query')}) > {S.QUERY_MAX_LEN}) then 'length:query' end")
    tn_int = f"({_jt('top_n')} in {_NUM} and {_jn('top_n')} = floor({_jn('top_n')}))"
    r.append(f"case when is_search and {_jt('top_n')} is not null and not {tn_int} then 'type:top_n' end")
    r.append(f"case when is_search and {tn_int} and ({_jn('top_n')} < {S.TOP_N_MIN} or {_jn('top_n')} > {S.TOP_N_MAX}) then 'range:top_n' end")
    r.append(f"case when {_jt('freshness')} is not null and {_jt('freshness')} <> 'VARCHAR' then 'type:freshness' end")
    sfr = ",".join(f"'{x}'" for x in S.SEARCH_FRESHNESS)
    ffr = ",".join(f"'{x}'" for x in S.FETCH_FRESHNESS)
    r.append(f"case when is_search and {_jt('freshness')} is not null and not coalesce({_jt('freshness')} = 'VARCHAR' and {_js('freshness')} in ({sfr}), false) then 'enum:freshness' end")
    r.append(f"case when is_fetch and {_jt('freshness')} is not null and not coalesce({_jt('freshness')} = 'VARCHAR' and {_js('freshness')} in ({ffr}), false) then 'enum:freshness' end")
    items = "json_extract(jv, '$.site_filter[*]')"
    sf_ok = (f"({_jt('site_filter')} = 'ARRAY' and len({items}) between {S.SITE_FILTER_MIN} and {S.SITE_FILTER_MAX}"
             f" and list_bool_and(list_transform({items}, lambda e: json_type(e) = 'VARCHAR'"
             f" and regexp_matches(json_extract_string(e, '$'), {Q.q(R.HOSTNAME_PATTERN)})"
             f" and length(json_extract_string(e, '$')) <= 253))"
             f" and len(list_distinct(list_transform({items}, lambda e: cast(e as varchar)))) = len({items}))")
    r.append(f"case when is_search and {_jt('site_filter')} is not null and not coalesce({sf_ok}, false) then 'items:site_filter' end")
    r.append(f"case when is_fetch and {_jt('url')} is not null and {_jt('url')} <> 'VARCHAR' then 'type:url' end")
    r.append(f"case when is_fetch and {_jt('url')} = 'VARCHAR' and (not regexp_matches({_js('url')}, {Q.q(R.URI_PATTERN)}) or length({_js('url')}) > {S.URL_MAX_LEN}) then 'format:url' end")
    mb_int = f"({_jt('max_bytes')} in {_NUM} and {_jn('max_bytes')} = floor({_jn('max_bytes')}))"
    r.append(f"case when is_fetch and {_jt('max_bytes')} is not null and not {mb_int} then 'type:max_bytes' end")
    r.append(f"case when is_fetch and {mb_int} and ({_jn('max_bytes')} < {S.MAX_BYTES_MIN} or {_jn('max_bytes')} > {S.MAX_BYTES_MAX}) then 'range:max_bytes' end")
    return r


def _validated_sql():
    sfields = "[" + ",".join(f"'{k}'" for k in S.SEARCH_FIELDS) + "]"
    ffields = "[" + ",".join(f"'{k}'" for k in S.FETCH_FIELDS) + "]"
    rules = ",\n  ".join(_rules_sql())
    extra = (f"list_transform(list_filter(json_keys(jv), lambda k: not list_contains("
             f"case when is_search then {sfields} else {ffields} end, k)), lambda k: 'additional:' || k)")
    return f"""l as materialized (select * from lines where regexp_replace(value, {Q.q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g') <> ''),
p as materialized (select seq, ts, value, case when strlen(value) > {S.MAX_REQUEST_LINE_BYTES} then 'too_large'
   when not json_valid(value) then 'invalid_json' end as parse_error,
   case when strlen(value) <= {S.MAX_REQUEST_LINE_BYTES} and json_valid(value) then value end as jv from l),
p2 as materialized (select *, json_type(jv) as top,
   case when json_type(jv) = 'OBJECT' then {_jt('contract_id')} end as cid_t,
   case when json_type(jv) = 'OBJECT' then {_js('contract_id')} end as cid from p),
p3 as materialized (select *, cid = 'web.search.v1' as is_search, cid = 'web.fetch.v1' as is_fetch,
   case when parse_error is not null then null when top not in ('OBJECT', 'ARRAY') then 'envelope is not an object'
     when top = 'ARRAY' or coalesce(cid_t, '') <> 'VARCHAR' then 'contract_id missing or not a string'
     when cid not in ('web.search.v1', 'web.fetch.v1') then concat('unknown contract_id ''', cid, '''') end as pre from p2),
v as materialized (select seq, ts, value, jv, parse_error, is_search, is_fetch,
   case when parse_error is not null then null when pre is not null then pre
     else nullif(array_to_string(list_concat(list_filter([
  {rules}
  ], lambda x: x is not null), {extra}), '; '), '') end as errors from p3),
vv as materialized (select *, parse_error is null and errors is null as valid, {_js('source_ref')} as source_ref_v from v)"""


#: The lines as files bring them: numbered in order of arrival; the files' times lie seconds apart, which no ttl tells.
FILE_LINES_SQL = f"""numbers as (select seq as log_seq, row_number() over (order by ts, seq) - 1 as seq from req),
log_lines as (select seq as log_seq, {FX.LINE_EXPR} as value from req),
lines as (select n.seq, timestamp '2024-02-01 00:30:00' as ts, l.value from log_lines l join numbers n on n.log_seq = l.log_seq)"""


def _sql(body: str, *ctes: str) -> str:
    return FX.with_ctes(FX.REQ_SQL, FX.LINES_SQL, *ctes) + body


_VAL = _validated_sql()


@register("req_parse", _sql("select seq, parse_error from p", _VAL))
def req_parse(spark, sf_dir):
    return parsed_lines(spark, sf_dir).select("seq", "parse_error")


@register("req_validate", _sql("select seq, parse_error, valid, errors from vv", _VAL))
def req_validate(spark, sf_dir):
    return validated(spark, sf_dir).select("seq", "parse_error", "valid", "errors")


ARRIVAL_MS = 1706747400_000  # 2024-02-01T00:30:00Z, when the first file of request lines arrives


def text_dir(spark, sf_dir):
    """The derived request lines as NDJSON text files that arrive one after another, stored once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TEXT_DIRS:
        path = scratch_path(spark, f"request-lines-text-{uuid.uuid4().hex}")
        lines = FX.request_lines(spark, sf_dir)
        RS.write_lines(lines.repartitionByRange(8, "ts", "seq").sortWithinPartitions("ts", "seq"), path)
        RS.set_arrival(spark, path, ARRIVAL_MS)
        _TEXT_DIRS[key] = path
    return _TEXT_DIRS[key]


_TEXT_DIRS: dict = {}


@register("req_text_parse_counts", _sql(f"""select parse_error, count(*) as n from (
 select case when strlen(value) > {S.MAX_REQUEST_LINE_BYTES} then 'too_large' when not json_valid(value) then 'invalid_json' end as parse_error
 from lines where regexp_replace(value, {Q.q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g') <> '')
 group by parse_error"""))
def req_text_parse_counts(spark, sf_dir):
    """O1 through the text source: NDJSON files -> blank lines skipped -> strict parse -> counts."""
    p = R.parse_lines(RS.read_lines(spark, text_dir(spark, sf_dir)))
    return p.groupBy("parse_error").agg(F.count(F.lit(1)).alias("n"))


@register("req_violation_counts", _sql("""select rule, count(*) as n from (select unnest(string_split(errors, '; ')) as rule
 from vv where errors is not null) group by rule""", _VAL))
def req_violation_counts(spark, sf_dir):
    # explode of a NULL error string yields no rows, so no filter is needed (a filter on ``errors`` would be
    # pushed below the projection and re-evaluate the whole rule list)
    v = validated(spark, sf_dir)
    return (v.select(F.explode(F.split("errors", "; ")).alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


_ADMIT_SQL = _VAL + """,
ranked as materialized (select seq, row_number() over (partition by source_ref_v order by ts, seq) as rk from vv where valid),
adm as (select vv.seq, case when vv.parse_error is not null then 'bad_query' when not vv.valid then 'validation_failed'
   when r.rk > 5 then 'budget_exhausted' else 'admitted' end as code from vv left join ranked r on r.seq = vv.seq)"""


@register("request_admission", _sql("select seq, code from adm", _ADMIT_SQL))
def request_admission(spark, sf_dir):
    return admitted_lines(spark, sf_dir).select("seq", "code")


@register("response_code_counts_admission", _sql("select code, count(*) as n from adm group by code", _ADMIT_SQL))
def response_code_counts_admission(spark, sf_dir):
    return admitted_lines(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------------------------
# Budgets over the columnar request log
# ---------------------------------------------------------------------------------------------------
def budgeted_requests(spark, sf_dir):
    req = FX.requests(spark, sf_dir)
    valid = req.filter(F.col("trace_id").rlike(S.TRACE_ID_PATTERN))
    return B.task_budget(valid, "source_ref", ("ts", "seq"), S.OPS_PER_TASK, "seq")


_BUDGET_SQL = f"""bud as (select *, row_number() over (partition by source_ref order by ts, seq) <= 5 as budget_ok
 from req where regexp_matches(trace_id, {Q.q(S.TRACE_ID_PATTERN)}))"""


@register("task_budget", FX.with_ctes(FX.REQ_SQL, _BUDGET_SQL) + "select seq, source_ref, budget_ok from bud")
def task_budget(spark, sf_dir):
    return budgeted_requests(spark, sf_dir).select("seq", "source_ref", "budget_ok")


@register("ops_per_task", FX.with_ctes(FX.REQ_SQL, _BUDGET_SQL) + """select source_ref, count(*) as n_requests,
 count(*) filter (where budget_ok) as n_admitted, count(*) filter (where not budget_ok) as n_denied from bud group by source_ref""")
def ops_per_task(spark, sf_dir):
    return B.ops_per_task(budgeted_requests(spark, sf_dir))


@register("daily_ops", FX.with_ctes(FX.REQ_SQL, _BUDGET_SQL) + f"""select strftime(ts, '%Y-%m-%d') as day, count(*) as n_ops,
 least(count(*), {S.OPS_PER_DAY}) as n_within_cap, count(*) - least(count(*), {S.OPS_PER_DAY}) as n_over_cap
from bud where budget_ok group by 1""")
def daily_ops(spark, sf_dir):
    return B.daily_ops(budgeted_requests(spark, sf_dir).filter("budget_ok"))


@register("monthly_spend", FX.with_ctes(FX.REQ_SQL, _BUDGET_SQL) + f"""select strftime(ts, '%Y-%m') as month, count(*) as n_searches,
 cast(count(*) * cast({S.USD_PER_SEARCH} as decimal(18,6)) as decimal(18,6)) as spend_usd,
 least(count(*), 1666) as n_within_budget, count(*) * cast({S.USD_PER_SEARCH} as decimal(18,6)) > {S.BUDGET_USD_MONTH} as exhausted
from bud where budget_ok and contract_id = 'web.search.v1' group by 1""")
def monthly_spend(spark, sf_dir):
    b = budgeted_requests(spark, sf_dir).filter(F.col("budget_ok") & (F.col("contract_id") == S.CONTRACT_SEARCH))
    return B.monthly_spend(b)


_QCANON = f"regexp_replace(regexp_replace(query, {Q.q(WS + '+')}, ' ', 'g'), {Q.q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"
@register("daily_cap", FX.with_ctes(FX.REQ_SQL, _BUDGET_SQL) + f"""select seq, strftime(ts, '%Y-%m-%d') as day,
 row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, seq) <= {S.OPS_PER_DAY} as within_cap
from bud where budget_ok""")
def daily_cap(spark, sf_dir):
    return B.daily_cap(budgeted_requests(spark, sf_dir).filter("budget_ok")).select("seq", "day", "within_cap")


@register("monthly_spend_running", FX.with_ctes(FX.REQ_SQL, _BUDGET_SQL) + """select seq, strftime(ts, '%Y-%m') as month,
 row_number() over (partition by strftime(ts, '%Y-%m') order by ts, seq) <= 1666 as within_budget
from bud where budget_ok and contract_id = 'web.search.v1'""")
def monthly_spend_running(spark, sf_dir):
    b = budgeted_requests(spark, sf_dir).filter(F.col("budget_ok") & (F.col("contract_id") == S.CONTRACT_SEARCH))
    return B.spend_running(b).select("seq", "month", "within_budget")


_DEDUPE_SQL = f"""dk as (select seq, ts, sha256(case when contract_id = 'web.fetch.v1'
  then concat_ws(':', caller_agent_id, contract_id, {Q.canonical('url')}, freshness)
  else concat_ws(':', caller_agent_id, contract_id, lower({_QCANON}), cast(top_n as varchar), freshness,
   coalesce(array_to_string({FX.SITE_FILTER_SQL}, ','), 'empty')) end) as dedupe_key from req)"""


@register("request_dedupe", FX.with_ctes(FX.REQ_SQL, _DEDUPE_SQL) + """select dedupe_key, arg_min(seq, (ts, seq)) as first_seq,
 count(*) as n_requests from dk group by dedupe_key""")
def request_dedupe(spark, sf_dir):
    return (keyed_requests(spark, sf_dir).groupBy(F.col("computed_key").alias("dedupe_key"))
            .agg(F.min_by("seq", F.struct("ts", "seq")).alias("first_seq"), F.count(F.lit(1)).alias("n_requests")))


def keyed_requests(spark, sf_dir):
    """The request log with the dedupe key by the declared rule."""
    k = R.dedupe_key("contract_id", "caller_agent_id", "url", "query", "top_n", "freshness", "site_filter")
    return FX.requests(spark, sf_dir).withColumn("site_filter", FX.site_filter()).withColumn("computed_key", k)


#: What clients declare: the right key, a key of their own, or none, by the request's number.
DECLARED_SQL = "case when seq % 5 = 1 then concat('d', cast(seq as string)) when seq % 11 <> 3 then {0} end"


@register("dedupe_key_mismatches", FX.with_ctes(FX.REQ_SQL, _DEDUPE_SQL) + f"""select * from (select seq,
 {DECLARED_SQL.format('dedupe_key').replace('as string', 'as varchar')} as declared_key, dedupe_key as computed_key from dk)
 where declared_key is distinct from computed_key""")
def dedupe_key_mismatches(spark, sf_dir):
    """Requests whose declared dedupe key is not the one that the declared rule gives."""
    keyed = keyed_requests(spark, sf_dir).withColumn("declared_key", F.expr(DECLARED_SQL.format("computed_key")))
    return R.key_mismatches(keyed, "declared_key").select("seq", "declared_key", "computed_key")
