"""Registered queries: probe flags and domain-health verdicts (O25) over a probe log derived from page hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import urls as U
from ..operators import health as H
from ..sources.tables import read
from . import sqltext as Q
from .registry import register

# Fixed derivation rule: one probe per page host; the group is the host's registered domain (last two labels).
PROBE_EXPR = {
    "a_count": "case when page_id % 19 = 7 then 0 else 2 end",
    "aaaa_count": "case when page_id % 38 = 26 then 1 else 0 end",
    "dns_error": "case when page_id % 23 = 11 then 'queryA ESERVFAIL' end",
    "head_status": "case when page_id % 17 = 5 then 503 when page_id % 13 = 3 then 301 when page_id % 31 = 9 then 199 else 200 end",
    "head_error": "case when page_id % 29 = 14 then 'read ECONNRESET' end",
}


def probes(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url")
    h = U.hostname("url")
    return p.select(F.col("page_id").cast("int").alias("entry_index"), h.alias("domain"),
                    U.host_suffix(h, 2).alias("site"),
                    *[F.expr(e).cast("int" if "count" in k or k == "head_status" else "string").alias(k)
                      for k, e in PROBE_EXPR.items()])


PROBES_SQL = f"""probes as (select cast(page_id as integer) as entry_index, {Q.host('url')} as domain,
 case when len(string_split({Q.host('url')}, '.')) >= 2 then array_to_string(string_split({Q.host('url')}, '.')[-2:], '.') end as site,
 {', '.join(f'{e} as {k}' for k, e in PROBE_EXPR.items())} from pages),
flags as (select *, case when dns_error is not null then 'dns_error' when coalesce(a_count, 0) = 0 and coalesce(aaaa_count, 0) = 0 then 'dns_empty'
   when head_error is not null then 'head_error' when head_status is null or head_status < 200 or head_status >= 400 then 'head_status' end as kind
 from probes),
flags2 as (select *, case when kind like 'dns%' then 0 when kind is not null then 1 end as phase,
 case kind when 'dns_error' then dns_error when 'dns_empty' then '{S.DNS_EMPTY_ERROR}' when 'head_error' then head_error
   when 'head_status' then 'HTTP ' || coalesce(cast(head_status as varchar), '0') end as upstream_error from flags)"""

_CAUSES_SQL = "case v.kind " + " ".join(
    f"when '{k}' then '{H.CAUSE_SEP.join(v)}'" for k, v in S.HEALTH_CAUSES.items()) + " end"


@register("probe_flags", "with " + PROBES_SQL + """ select cast(entry_index as bigint) as entry_index, domain, site,
 phase, kind, upstream_error from flags2""")
def probe_flags(spark, sf_dir):
    f = H.probe_failures(probes(spark, sf_dir))
    return f.select(F.col("entry_index").cast("long").alias("entry_index"), "domain", "site", "phase", "kind",
                    "upstream_error")


@register("domain_health", "with " + PROBES_SQL + f""", v as (select site, phase, entry_index, domain, kind, upstream_error,
 row_number() over (partition by site order by phase, entry_index) as rk from flags2 where phase is not null),
sites as (select distinct site from probes)
select s.site, case when v.site is null then 'ok' else 'fail' end as status,
 case v.phase when 0 then 'dns' when 1 then 'head' end as step, v.domain as dependency, v.upstream_error,
 cast(v.entry_index as bigint) as entry_index, {_CAUSES_SQL} as ranked_causes
from sites s left join (select * from v where rk = 1) v on v.site = s.site""")
def domain_health(spark, sf_dir):
    return H.verdict(probes(spark, sf_dir), ["site"])
