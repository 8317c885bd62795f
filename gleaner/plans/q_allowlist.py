"""Registered queries: url parts (O10, D2), allowlist membership (O16), longest-suffix lookup (O17),
allowlist validation (O9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import allowlist as A
from ..sources import fixtures as FX
from ..sources.tables import read
from . import sqltext as Q
from .registry import register

_URL_PARTS_SQL = f"""select page_id, url, {Q.host('url')} as host, {Q.scheme('url')} as scheme,
 {Q.origin('url')} as origin, {Q.canonical('url')} as canonical_url from pages"""


@register("url_parts", _URL_PARTS_SQL)
def url_parts(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", "url", U.hostname("url").alias("host"), U.scheme("url").alias("scheme"),
                    U.origin("url").alias("origin"), U.canonical_url("url").alias("canonical_url"))


# Hostile and odd spellings of every page url: a prefix and a suffix around the url's own scheme, host or path.
_BACK, _TAB = chr(92), chr(9)
_EDGE = [
    "url", f"concat('  ', url, '{_TAB} ')", "concat(upper(substring(url, 1, 12)), substring(url, 13))",
    "replace(url, '://', ':{0}{0}')", "replace(url, '://', ':')", "replace(url, '://', ':////')",
    "concat('https://made-up.example{0}.', replace(url, 'https://', ''))", "concat('https://made-up.example{0}@', replace(url, 'https://', ''))",
    "concat('https://me:pw@made-up.example@', replace(url, 'https://', ''))", "replace(url, '.example.', '.example.:99999/')",
    "concat('https://example.com:65536/', cast(page_id as string))", "concat('https://example.com:65535/', cast(page_id as string))",
    "concat('https://example.com:00443/', cast(page_id as string))", "concat('https://a<b.example.com/', cast(page_id as string))",
    "concat('https://a^b.example.com/', cast(page_id as string))", "concat('https://ex%61mple.com/', cast(page_id as string))",
    "concat('https://a|b.example.com:80/', cast(page_id as string))", "concat('https://exam', chr(10), 'ple.com/', cast(page_id as string))",
    "concat('https://made-up.example?.example.com/', cast(page_id as string))", "concat('https://made-up.example#@example.com/', cast(page_id as string))",
    "concat('other://me@example.com:7/', cast(page_id as string))", "concat('https://[::1]:8080/', cast(page_id as string))",
    "concat('https:', cast(page_id as string), '.example.org')", "concat('//example.com/', cast(page_id as string))", "''",
]
_EDGE = [e.format(_BACK * 2) if "{0}" in e else e for e in _EDGE]


def _edge_list(back: str) -> str:
    return ", ".join(e.replace(_BACK * 2, back) for e in _EDGE)


@register("url_edge_cases", FX.with_ctes(FX.AL_SQL) + f""", v as (select page_id, unnest([{_edge_list(_BACK)}]) as url,
 unnest(range({len(_EDGE)})) as variant from pages),
h as (select *, page_id * 100 + variant as id, {Q.host('url')} as host, {Q.origin('url')} as origin,
 {Q.canonical('url')} as canonical_url from v)
select h.page_id, cast(h.variant as bigint) as variant, h.url, h.host, h.origin, h.canonical_url, b.domain from h
left join {Q.allow_best('s.url', 's.id', 'h')} b on b.id = h.id""")
def url_edge_cases(spark, sf_dir):
    """Where odd spellings of every page's url lead, and whether the gate opens for them."""
    p = read(spark, sf_dir, "pages", "page_id", "url")
    v = p.select("page_id", F.posexplode(F.expr(f"array({_edge_list(_BACK * 2)})")).alias("variant", "url"))
    out = A.lookup(v, "url", FX.allowlist(spark))
    return out.select("page_id", F.col("variant").cast("long").alias("variant"), "url", U.hostname("url").alias("host"),
                      U.origin("url").alias("origin"), U.canonical_url("url").alias("canonical_url"),
                      F.col("al_domain").alias("domain"))


_SEMI_SQL = FX.with_ctes(FX.AL_SQL) + f"""select page_id, url from pages p where exists (select 1 from al where
 {Q.host('p.url')} = al.domain or ends_with({Q.host('p.url')}, '.' || al.domain))"""
_ANTI_SQL = FX.with_ctes(FX.AL_SQL) + f"""select page_id, url from pages p where not exists (select 1 from al where
 {Q.host('p.url')} = al.domain or ends_with({Q.host('p.url')}, '.' || al.domain))"""


@register("allow_semi", _SEMI_SQL)
def allow_semi(spark, sf_dir):
    return A.semi(read(spark, sf_dir, "pages", "page_id", "url"), "url", FX.allowlist(spark))


@register("allow_anti", _ANTI_SQL)
def allow_anti(spark, sf_dir):
    return A.anti(read(spark, sf_dir, "pages", "page_id", "url"), "url", FX.allowlist(spark))


_LOOKUP_SQL = FX.with_ctes(FX.AL_SQL) + f"""select p.page_id, p.url, {Q.host('p.url')} as host,
 cast(b.entry_index as bigint) as entry_index, b.domain, b.purpose, b.ttl_class,
 cast(case b.ttl_class when 'insurance-med' then 86400 when 'airline' then 3600 when 'generic' then 604800 end as bigint) as ttl_seconds
from pages p left join {Q.allow_best('s.url', 's.page_id', 'pages')} b on b.page_id = p.page_id"""


@register("allow_lookup", _LOOKUP_SQL)
def allow_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url")
    out = A.lookup(p, "url", FX.allowlist(spark))
    return out.select("page_id", "url", U.hostname("url").alias("host"),
                      F.col("al_entry_index").cast("long").alias("entry_index"), F.col("al_domain").alias("domain"),
                      F.col("al_purpose").alias("purpose"), F.col("al_ttl_class").alias("ttl_class"),
                      F.col("al_ttl_seconds").alias("ttl_seconds"))


def _entries_from_pages(spark, sf_dir):
    """Candidate allowlist entries derived from every page host, with rule-breaking variants."""
    p = read(spark, sf_dir, "pages", "page_id", "url")
    pid = F.col("page_id")
    h = U.hostname("url")
    return p.select(
        pid.cast("int").alias("entry_index"),
        F.when(pid % 7 == 3, F.upper(h)).otherwise(h).alias("domain"),
        F.when(pid % 13 == 1, F.lit("")).otherwise(F.lit("page")).alias("purpose"),
        F.when(pid % 5 == 4, F.lit("weekly")).when(pid % 3 == 0, F.lit("generic"))
        .when(pid % 3 == 1, F.lit("airline")).otherwise(F.lit("insurance-med")).alias("ttl_class"),
        F.when(pid % 11 == 2, F.lit("yesterday")).when(pid % 11 == 3, F.lit("2026-02-30"))
        .otherwise(F.lit("2026-05-13")).alias("added_at"))


_ENTRIES_SQL = f"""entries as (select cast(page_id as integer) as entry_index,
 case when page_id % 7 = 3 then upper({Q.host('url')}) else {Q.host('url')} end as domain,
 case when page_id % 13 = 1 then '' else 'page' end as purpose,
 case when page_id % 5 = 4 then 'weekly' when page_id % 3 = 0 then 'generic' when page_id % 3 = 1 then 'airline'
      else 'insurance-med' end as ttl_class,
 case when page_id % 11 = 2 then 'yesterday' when page_id % 11 = 3 then '2026-02-30' else '2026-05-13' end as added_at
from pages)"""
_ERR_SQL = f"""(case when domain is null or not regexp_matches(domain, {Q.q(r'^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+\z')}) then 'domain'
 when purpose is null or length(purpose) = 0 then 'purpose'
 when ttl_class is null or ttl_class not in ('insurance-med','airline','generic') then 'ttl_class'
 when added_at is null or not regexp_matches(added_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\z') then 'added_at'
 when try_cast(added_at as date) is null then 'added_at_date' end)"""


@register("allowlist_entry_errors", "with " + _ENTRIES_SQL + f"""
select cast(entry_index as bigint) as entry_index, domain, {_ERR_SQL} as error from entries""")
def allowlist_entry_errors(spark, sf_dir):
    e = A.entry_error(_entries_from_pages(spark, sf_dir))
    return e.select(F.col("entry_index").cast("long").alias("entry_index"), "domain", "error")


@register("allowlist_validate", "with " + _ENTRIES_SQL + f""", errs as (select *, {_ERR_SQL} as error from entries),
bad as (select * from errs where error is not null order by entry_index limit 1)
select (select count(*) from entries) as n_entries,
 ((select count(*) from entries) > 0 and (select count(*) from bad) = 0) as ok,
 (select cast(entry_index as bigint) from bad) as bad_index, (select error from bad) as bad_rule,
 (select case when error = 'domain' then format('entry {{}} has invalid "domain"', entry_index)
   when error = 'added_at_date' then format('entry {{}} ("{{}}") "added_at" is not a real date', entry_index, domain)
   else format('entry {{}} ("{{}}") has invalid "{{}}"', entry_index, domain, error) end from bad) as message""")
def allowlist_validate(spark, sf_dir):
    return A.validate(_entries_from_pages(spark, sf_dir))
