"""Registered queries: crawl triage (O12), decode (O36), truncation (D3), extraction (O38), quality (O13),
fingerprints (O33), untrusted segments (O37)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks as BL
from ..operators import crawl as C
from ..operators import extract as XT
from ..sources import fixtures as FX
from ..sources.tables import read
from . import sqltext as Q
from .registry import register

MAXB = FX.CRAWL_MAX_BYTES

TRIAGE_SQL = f"""(case when error_name is not null then (case when error_name = 'AbortError' then 'timeout' else 'transport_error' end)
 when status < 200 or status >= 400 then 'non_2xx'
 when content_type is not null and content_type <> '' and not (starts_with(lower(content_type), 'text/html') or starts_with(lower(content_type), 'application/xhtml')) then 'invalid_content_type'
 when body is null then 'transport_error'
 when strlen(body) > {MAXB} then 'over_size_cap' end)"""

TRIAGED_SQL = f"""triaged as (select page_id, url as req_url, {TRIAGE_SQL} as reason,
 case when error_name is not null then url else coalesce(nullif(final_url, ''), url) end as doc_url,
 case when error_name is not null then {Q.origin('url')} else {Q.origin("coalesce(nullif(final_url, ''), url)", Q.origin('url'))} end as doc_origin,
 case when error_name is not null then 0 else status end as doc_status,
 case when error_name is not null then null else lower(content_type) end as doc_content_type,
 body, error_name from crawl),
triaged2 as (select *, reason is not null as low_signal,
 cast(case when reason is null or reason = 'over_size_cap' then strlen(body) else 0 end as bigint) as byte_size,
 case when reason is null then body else '' end as body_text from triaged)"""


def triaged(spark, sf_dir):
    return C.triage(FX.crawl(spark, sf_dir), max_bytes=MAXB)


@register("crawl_triage", FX.with_ctes(FX.CRAWL_SQL, TRIAGED_SQL) + """select page_id, doc_url as url,
 doc_origin as origin, cast(doc_status as bigint) as status, doc_content_type as content_type, byte_size,
 low_signal, reason from triaged2""")
def crawl_triage(spark, sf_dir):
    t = triaged(spark, sf_dir)
    return t.select("page_id", F.col("doc_url").alias("url"), F.col("doc_origin").alias("origin"),
                    F.col("doc_status").cast("long").alias("status"), F.col("doc_content_type").alias("content_type"),
                    "byte_size", "low_signal", "reason")


@register("crawl_reason_counts", FX.with_ctes(FX.CRAWL_SQL, TRIAGED_SQL) + """select coalesce(reason, 'usable') as reason,
 count(*) as n, cast(sum(byte_size) as bigint) as bytes from triaged2 group by 1""")
def crawl_reason_counts(spark, sf_dir):
    t = triaged(spark, sf_dir)
    return (t.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("byte_size").cast("long").alias("bytes")))


@register("decode_body", FX.with_ctes(FX.CRAWL_SQL, TRIAGED_SQL) + """select page_id, byte_size,
 length(body_text) as n_chars, sha256(body_text) as text_sha256 from triaged2""")
def decode_body(spark, sf_dir):
    t = triaged(spark, sf_dir)
    return t.select("page_id", "byte_size", F.length("body_text").cast("long").alias("n_chars"),
                    X.sha256_hex("body_text").alias("text_sha256"))


@register("body_truncate", FX.with_ctes(FX.CRAWL_SQL) + """select page_id, cast(1024 + abs(page_id % 5) * 2048 as bigint) as max_bytes,
 cast(strlen(body) as bigint) as byte_size,
 cast(case when body is not null then least(strlen(body), 1024 + abs(page_id % 5) * 2048) end as bigint) as kept_bytes,
 strlen(body) > 1024 + abs(page_id % 5) * 2048 as truncated
from crawl""")
def body_truncate(spark, sf_dir):
    c = FX.crawl(spark, sf_dir)
    mb = (F.lit(1024) + F.abs(F.col("page_id") % 5) * 2048).cast("long")
    t = C.truncate_body(F.col("body"), mb)
    return c.select("page_id", mb.alias("max_bytes"), F.octet_length("body").cast("long").alias("byte_size"),
                    t.kept_bytes.alias("kept_bytes"), t.truncated.alias("truncated"))


_PT, _PX = XT.native_extract_sql("html")
EXTRACT_PAGES_SQL = f"""ext as (select page_id, url, {_PT} as title, {_PX} as plaintext from pages)"""


@register("page_extract", FX.with_ctes(EXTRACT_PAGES_SQL) + f"""select page_id, url, title, plaintext,
 {XT.quality_sql('title', 'plaintext')} is not null as low_signal, {XT.quality_sql('title', 'plaintext')} as reason from ext""")
def page_extract(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return XT.extract(p, "html").select("page_id", "url", "title", "plaintext", "low_signal", "reason")


_CT, _CX = XT.native_extract_sql("body")
EXTRACT_CRAWL_SQL = f"""cext as (select page_id, {_CT} as title, {_CX} as plaintext, body from crawl)"""


@register("page_quality", FX.with_ctes(FX.CRAWL_SQL, EXTRACT_CRAWL_SQL) + f"""select page_id, title,
 body is null or {XT.quality_sql('title', 'plaintext')} is not null as low_signal,
 case when body is null then 'parse_error' else {XT.quality_sql('title', 'plaintext')} end as reason,
 cast(length(coalesce(plaintext, '')) as bigint) as n_chars from cext""")
def page_quality(spark, sf_dir):
    c = FX.crawl(spark, sf_dir).withColumn("html", X.decode_body(F.col("body")))
    e = XT.extract(c, "html")
    return e.select("page_id", "title", "low_signal", "reason", F.length("plaintext").cast("long").alias("n_chars"))


@register("render_segments", FX.with_ctes(EXTRACT_PAGES_SQL) + f"""select page_id,
 concat('<UNTRUSTED_WEB origin=', {Q.origin('url')}, ' sha256=', sha256(plaintext), '>' || chr(10),
 replace(plaintext, '</UNTRUSTED_WEB>', '<!- UNTRUSTED_WEB-ESCAPED -!>'), chr(10) || '</UNTRUSTED_WEB>') as segment from ext""")
def render_segments(spark, sf_dir):
    from ..functions import urls as U
    p = XT.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), "html")
    return p.select("page_id", X.render_segment(U.origin("url"), X.sha256_hex("plaintext"), F.col("plaintext"))
                    .alias("segment"))


@register("fingerprint", FX.with_ctes(FX.CRAWL_SQL, TRIAGED_SQL) + f""", fx as (select page_id, doc_url, reason as t_reason,
 {_CT.replace('body', 'body_text')} as title, {_CX.replace('body', 'body_text')} as plaintext from triaged2)
select page_id, doc_url as url,
 case when t_reason is not null or {XT.quality_sql('title', 'plaintext')} is not null
      then sha256('__low_signal__:' || doc_url) else sha256(plaintext) end as content_sha256 from fx""")
def fingerprint(spark, sf_dir):
    t = XT.extract(triaged(spark, sf_dir).withColumnRenamed("reason", "t_reason"), "body_text")
    low = F.col("t_reason").isNotNull() | F.col("low_signal")
    return t.select("page_id", F.col("doc_url").alias("url"),
                    F.when(low, X.low_signal_sha(F.col("doc_url"))).otherwise(X.sha256_hex("plaintext"))
                    .alias("content_sha256"))


_FAILS = "case abs(page_id) % 7 " + " ".join(f"when {r} then {at}" for r, (at, _) in FX.BROKEN.items()) + " end"
_TIMES_OUT = "abs(page_id) % 7 in (" + ", ".join(str(r) for r, (_, name) in FX.BROKEN.items() if name == "AbortError") + ")"


@register("crawl_body_errors", FX.with_ctes(FX.CRAWL_SQL, TRIAGED_SQL) + f""",
b as (select *, {_FAILS} as fails, strlen(body) as len from triaged2 where reason is null or reason = 'over_size_cap'),
r as (select *, fails is not null and fails <= ceil(len / {FX.PIECE}) and (len <= {MAXB} or fails <= {MAXB} // {FX.PIECE}) as broken from b)
select t.page_id as fetch_id, t.doc_url as url, cast(t.doc_status as bigint) as status,
 case when r.broken then case when {_TIMES_OUT.replace('page_id', 't.page_id')} then 'timeout' else 'transport_error' end else t.reason end as reason,
 cast(case when r.broken then least(r.fails * {FX.PIECE}, r.len) when t.reason = 'over_size_cap' then least(({MAXB} // {FX.PIECE} + 1) * {FX.PIECE}, r.len)
   else t.byte_size end as bigint) as byte_size,
 case when t.reason is null and not r.broken then sha256(t.body_text) else sha256('') end as text_sha256
from triaged2 t left join r on r.page_id = t.page_id""")
def crawl_body_errors(spark, sf_dir):
    """Bodies in chunks, cut where the cap is crossed or a read fails."""
    t = C.triage(C.read_bodies(*FX.chunked_crawl(spark, sf_dir), MAXB), MAXB)
    return t.select("fetch_id", F.col("doc_url").alias("url"), F.col("doc_status").cast("long").alias("status"), "reason",
                    "byte_size", X.sha256_hex("body_text").alias("text_sha256"))


#: Malformed UTF-8 (hex) and what a decoder makes of it: one U+FFFD per maximal part of a sequence; a byte order mark
#: is dropped at the very start only.
MALFORMED = [("C3", 1, ""), ("E282", 1, ""), ("F09F98", 1, ""), ("C080", 2, ""), ("C1BF", 2, ""), ("E08080", 3, ""), ("EDA080", 3, ""),
             ("EDBFBF", 3, ""), ("F0808080", 4, ""), ("F4908080", 4, ""), ("F8888080", 4, ""), ("FF", 1, ""), ("FEFF", 2, ""),
             ("80", 1, ""), ("E28241", 1, "A"), ("F09F41", 1, "A"), ("C3C3", 2, ""), ("E2E2", 2, ""), ("EFBBBF", 0, "\ufeff")]


@register("decode_malformed", "select page_id, n as case_no, sha256(coalesce(html, '') || what || 'z') as text_sha256, "
          "cast(length(coalesce(html, '') || what || 'z') as bigint) as n_chars from pages, (values "
          + ", ".join(f"({n}, repeat(chr(65533), {k}) || {Q.q(more)})" for n, (_, k, more) in enumerate(MALFORMED)) + ") as t(n, what)")
def decode_malformed(spark, sf_dir):
    """Every page's html, with a byte order mark before it on even pages, malformed bytes and a letter behind it."""
    p = read(spark, sf_dir, "pages", "page_id", "html").withColumn(
        "x", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.unhex(F.lit(h)).alias("b")) for n, (h, *_) in enumerate(MALFORMED)])))
    mark = F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    body = F.concat(mark, F.encode(F.coalesce("html", F.lit("")), "UTF-8"), F.col("x.b"), F.encode(F.lit("z"), "UTF-8"))
    text = X.decode_body(body)
    return p.select("page_id", F.col("x.n").alias("case_no"), X.sha256_hex(text).alias("text_sha256"),
                    F.length(text).cast("long").alias("n_chars"))


_DROPPED = f"regexp_replace(html, {Q.q(BL.HEAD_PATTERN)}, ' ', 'gs')"
for _p, _r in XT.DROP_STEPS:
    _DROPPED = f"regexp_replace({_DROPPED}, {Q.q(_p)}, {Q.q(_r)}, 'g')"
_BLOCK_LIST = ", ".join(Q.q(t) for t in BL.BLOCK_TAGS)
#: The nesting depth is carried by a fold over the tags here, not by running sums.
BLOCKS_SQL = f"""with t as (select page_id, unnest(tokens) as token, unnest(range(len(tokens))) as pos
  from (select page_id, regexp_extract_all({_DROPPED}, {Q.q(BL.TOKEN_PATTERN)}) as tokens from pages)),
n as (select *, case when starts_with(token, '<') and ends_with(token, '>') then lower(regexp_extract(token, {Q.q(BL.NAME_PATTERN)}, 1)) end as name,
  starts_with(token, '</') as closes from t),
s as (select *, case when name in ({_BLOCK_LIST}) and not ends_with(token, '/>') then case when closes then -1 else 1 end else 0 end as step,
  case when name = 'a' then case when closes then 0 else 1 end end as link from n),
b as materialized (select *, sum(abs(step)) over w as block_no, coalesce(last_value(link ignore nulls) over w, 0) as in_link
  from s window w as (partition by page_id order by pos rows unbounded preceding)),
d as (select page_id, block_no, list_reduce(list_prepend(0::bigint, list(step::bigint order by block_no) over (partition by page_id order by block_no
    rows unbounded preceding)), lambda x, y: greatest(x + y, 0)) as depth from b where step <> 0),
x as (select page_id, block_no, string_agg(txt, '' order by pos) as txt, string_agg(case when in_link = 1 then txt else '' end, '' order by pos) as linked
  from (select *, case when name is null then token when name in ('br', 'hr', 'img') then ' ' else '' end as txt from b) group by page_id, block_no),
c as (select page_id, block_no, {XT._sql_collapse(XT._sql_unescape('txt'))} as txt, {XT._sql_collapse(XT._sql_unescape('linked'))} as linked from x)
select c.page_id, cast(c.block_no as bigint) as block_no, cast(coalesce(d.depth, 0) as bigint) as depth, cast(length(txt) as bigint) as n_chars,
 cast(length(linked) as bigint) as link_chars,
 length(txt) - length(linked) >= {BL.LEAST_TEXT} and length(linked) * 2 <= length(txt) as content, sha256(txt) as text_sha256
from c left join d on d.page_id = c.page_id and d.block_no = c.block_no where length(txt) > 0"""


@register("page_blocks", BLOCKS_SQL)
def page_blocks(spark, sf_dir):
    """Every page's text blocks with depth, link density and verdict."""
    b = BL.page_blocks(read(spark, sf_dir, "pages", "page_id", "html"))
    return b.select("page_id", F.col("block_no").cast("long").alias("block_no"), F.col("depth").cast("long").alias("depth"), "n_chars", "link_chars",
                    "content", X.sha256_hex("text").alias("text_sha256"))
