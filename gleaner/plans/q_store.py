"""Registered queries: page upsert (O5/O28), provenance append (O6), store lookup with freshness gate (O20),
provenance semi join (O21), per-origin inventory (D6), TTL replay (O43)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions import urls as U
from ..operators import allowlist as A
from ..operators import extract as XT
from ..operators import replay as RP
from ..operators import store as ST
from ..sources import fixtures as FX
from ..session import materialize
from ..sources.tables import read
from . import sqltext as Q
from .q_citations import PROV_SQL, provenance
from .q_crawl import EXTRACT_PAGES_SQL
from .registry import register

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z


def iso_sql(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def parse_iso_sql(s: str) -> str:
    return f"try_cast(replace({s}, 'Z', '') as timestamp)"


_SNAPSHOTS: dict = {}


def snapshot(spark, sf_dir):
    """The page-store snapshot input table, derived once per application and kept as Parquet under
    ``spark.checkpoint.dir`` (a page store is a stored table; its derivation is not part of the jobs that read it)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = materialize(derive_snapshot(spark, sf_dir), "page-snapshot")
    return _SNAPSHOTS[key]


def derive_snapshot(spark, sf_dir):
    """Page store snapshot: every page extracted, fetched one hour apart, some with unparsable times."""
    p = XT.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), "html")
    p = A.lookup(p, "url", FX.allowlist(spark))
    pid = F.col("page_id")
    fetched = F.when(pid % 17 == 9, F.lit("not a date")).otherwise(
        X.iso_ms(F.timestamp_seconds(F.lit(EPOCH_2024) + pid * 3600)))
    sha = F.when(F.col("low_signal"), X.low_signal_sha(F.col("url"))).otherwise(X.sha256_hex("plaintext"))
    return p.select("url", U.origin("url").alias("origin"), sha.alias("content_sha256"),
                    F.when(F.col("low_signal"), F.lit("")).otherwise(F.col("plaintext")).alias("plaintext"),
                    "title", fetched.alias("fetched_at"),
                    F.coalesce(F.col("al_ttl_seconds"), F.lit(S.TTL_SECONDS["generic"]).cast("long")).alias("ttl_seconds"),
                    "low_signal", F.octet_length("html").cast("long").alias("byte_size"),
                    F.lit(-1).cast("long").alias("write_seq"))


SNAP_SQL = EXTRACT_PAGES_SQL + f""",
extq as (select *, {XT.quality_sql('title', 'plaintext')} as reason from ext),
bestal as {Q.allow_best('s.url', 's.page_id', 'pages')},
snap as (select e.url, {Q.origin('e.url')} as origin,
 case when e.reason is not null then sha256('__low_signal__:' || e.url) else sha256(e.plaintext) end as content_sha256,
 case when e.reason is not null then '' else e.plaintext end as plaintext, e.title,
 case when e.page_id % 17 = 9 then 'not a date' else {iso_sql("(timestamp '2024-01-01 00:00:00' + to_hours(e.page_id))")} end as fetched_at,
 cast(coalesce({Q.TTL_CASE.replace('ttl_class', 'b.ttl_class')}, 604800) as bigint) as ttl_seconds,
 e.reason is not null as low_signal, cast(strlen(p.html) as bigint) as byte_size, cast(-1 as bigint) as write_seq
 from extq e join pages p on p.page_id = e.page_id left join bestal b on b.page_id = e.page_id)"""


def fetch_requests(spark, sf_dir):
    return FX.requests(spark, sf_dir).filter(F.col("contract_id") == S.CONTRACT_FETCH)


def writes(spark, sf_dir):
    """One page write per fetch request, in request order (write_seq = seq)."""
    r = fetch_requests(spark, sf_dir)
    return r.select("url", U.origin("url").alias("origin"),
                    X.sha256_hex(F.concat_ws(":", "url", F.col("seq").cast("string"))).alias("content_sha256"),
                    F.concat(F.lit("fetch "), F.col("seq").cast("string")).alias("plaintext"),
                    F.lit(None).cast("string").alias("title"), X.iso_ms("ts").alias("fetched_at"),
                    F.lit(3600).cast("long").alias("ttl_seconds"), (F.col("event_type") == "error").alias("low_signal"),
                    F.col("seq").cast("long").alias("byte_size"), F.col("seq").cast("long").alias("write_seq"))


WRITES_SQL = f"""wr as (select url, {Q.origin('url')} as origin, sha256(concat_ws(':', url, cast(seq as varchar))) as content_sha256,
 concat('fetch ', cast(seq as varchar)) as plaintext, cast(null as varchar) as title, {iso_sql('ts')} as fetched_at,
 cast(3600 as bigint) as ttl_seconds, event_type = 'error' as low_signal, cast(seq as bigint) as byte_size,
 cast(seq as bigint) as write_seq from req where contract_id = 'web.fetch.v1')"""

_PAGE_COLS = ", ".join(ST.PAGE_COLS)


@register("page_upsert", FX.with_ctes(FX.AL_SQL, SNAP_SQL, FX.REQ_SQL, WRITES_SQL) + f"""select {_PAGE_COLS}, write_seq from (
 select *, row_number() over (partition by url order by write_seq desc) as rk from (
  select {_PAGE_COLS}, write_seq from snap union all select {_PAGE_COLS}, write_seq from wr)) where rk = 1""")
def page_upsert(spark, sf_dir):
    return ST.upsert(snapshot(spark, sf_dir), writes(spark, sf_dir)).select(*ST.PAGE_COLS, "write_seq")


@register("origin_inventory", FX.with_ctes(FX.AL_SQL, SNAP_SQL) + """select origin, count(*) as n_pages,
 cast(sum(byte_size) as bigint) as bytes, max(fetched_at) as last_fetched_at,
 round(avg(cast(low_signal as double)), 6) as low_signal_share from snap group by origin""")
def origin_inventory(spark, sf_dir):
    return ST.origin_inventory(snapshot(spark, sf_dir))


def lookup_requests(spark, sf_dir):
    r = A.lookup(fetch_requests(spark, sf_dir), "url", FX.allowlist(spark))
    return r.withColumn("bypass_cache", F.col("freshness") == "realtime").withColumnRenamed("ts", "now")


REQF_SQL = f"""reqf as (select r.*, b.ttl_class as al_ttl_class,
 {Q.TTL_CASE.replace('ttl_class', 'b.ttl_class')} as al_ttl from req r
 left join {Q.allow_best('s.url', 's.seq', 'req')} b on b.seq = r.seq where r.contract_id = 'web.fetch.v1')"""


#: The allowlist entry of each page's url and failure url, found once per url; freshness as one comparison.
_LOOKUP_SQL = f"""urls as materialized (select url from pages union select url || '{FX.FAILURE_MARK}' from pages union select ''),
entry as materialized (select url, {Q.TTL_CASE} as ttl from {Q.allow_best('s.url', 's.url', 'urls')}),
stored as materialized (select url, epoch_us({parse_iso_sql('fetched_at')}) as fetched from (select url, case when page_id % 17 = 9
 then 'not a date' else {iso_sql("(timestamp '2024-01-01 00:00:00' + to_hours(page_id))")} end as fetched_at from pages)
 where {parse_iso_sql('fetched_at')} is not null),
asked as materialized (select r.seq, r.url, case when r.freshness <> 'realtime' then r.url end as look_url,
 epoch_us(r.ts) - cast(e.ttl as bigint) * 1000000 as oldest
 from req r left join entry e on e.url = r.url where r.contract_id = 'web.fetch.v1')"""


@register("cache_lookup", FX.with_ctes(FX.AL_SQL, FX.REQ_SQL, _LOOKUP_SQL) + """select a.seq, a.url, s.url is not null as hit
 from asked a left join stored s on s.url = a.look_url and s.fetched >= a.oldest""")
def cache_lookup(spark, sf_dir):
    r = lookup_requests(spark, sf_dir)
    j = ST.cache_lookup(r, snapshot(spark, sf_dir).drop("write_seq"), now_col="now", ttl_col="al_ttl_seconds")
    return j.select("seq", "url", F.col("cache_hit").alias("hit"))


def provenance_candidates(spark, sf_dir):
    r = FX.requests(spark, sf_dir)
    kind = (F.when(F.col("event_type") == "error", F.lit("invalid"))
            .when(F.col("contract_id") == S.CONTRACT_SEARCH, F.lit("search")).otherwise(F.lit("fetch")))
    return r.select("seq", "url", U.origin("url").alias("origin"), X.sha256_hex("url").alias("content_sha256"),
                    X.iso_ms("ts").alias("fetched_at"), F.col("caller_agent_id").alias("requesting_agent_id"),
                    F.when(F.col("user_id") % 11 == 0, F.lit(None)).otherwise(F.col("source_ref")).alias("task_id"),
                    kind.alias("kind"))


@register("provenance_append", FX.with_ctes(FX.REQ_SQL) + f"""select * from (select seq, url, {Q.origin('url')} as origin,
 sha256(url) as content_sha256, {iso_sql('ts')} as fetched_at, caller_agent_id as requesting_agent_id,
 case when user_id % 11 = 0 then null else source_ref end as task_id,
 case when event_type = 'error' then 'invalid' when contract_id = 'web.search.v1' then 'search' else 'fetch' end as kind
 from req) where kind in ('search', 'fetch')""")
def provenance_append(spark, sf_dir):
    rows = ST.provenance_rows(provenance_candidates(spark, sf_dir))
    return rows.filter("accepted").drop("accepted")


@register("provenance_semi", FX.with_ctes(FX.CRAWL_SQL, PROV_SQL) + """select page_id, url from pages
 where sha256(html) in (select content_sha256 from prov)""")
def provenance_semi(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url", "html").withColumn("content_sha256", X.sha256_hex("html"))
    return ST.provenance_semi(p, provenance(spark, sf_dir)).select("page_id", "url")


@register("ttl_replay")
def ttl_replay(spark, sf_dir):
    r = lookup_requests(spark, sf_dir).filter(F.col("al_ttl_seconds").isNotNull())
    return RP.ttl_replay(r.withColumn("realtime", F.col("bypass_cache")), ts_col="now", ttl_col="al_ttl_seconds")


# TTL replay oracle: a recursive CTE folds each url's ordered requests (DuckDB needs WITH RECURSIVE first).
_REPLAY_SQL = ("with recursive " + ",\n".join([FX.AL_SQL, FX.REQ_SQL, REQF_SQL]) + """,
ev as (select url, seq, ts, freshness = 'realtime' as realtime, al_ttl as ttl,
  row_number() over (partition by url order by ts, seq) as rn from reqf where al_ttl is not null),
f as (select url, rn, seq, false as hit, ts as last_ref from ev where rn = 1
  union all
  select e.url, e.rn, e.seq,
   (not e.realtime and epoch_us(e.ts) - epoch_us(f.last_ref) <= cast(e.ttl as bigint) * 1000000) as hit,
   case when (not e.realtime and epoch_us(e.ts) - epoch_us(f.last_ref) <= cast(e.ttl as bigint) * 1000000) then f.last_ref else e.ts end
  from f join ev e on e.url = f.url and e.rn = f.rn + 1)
select seq, url, hit from f""")

from .registry import ORACLES  # noqa: E402

ORACLES["ttl_replay"] = _REPLAY_SQL
