"""Registered queries: sentence split (O30), URL extraction (O31), citation post-filter (O41 = O22-O24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as CI
from ..operators import crawl as C
from ..sources import fixtures as FX
from ..sources.tables import read
from . import sqltext as Q
from .q_crawl import TRIAGE_SQL
from .registry import register

WS = X.WS
SPLIT_RE = r"([.!?])" + WS + r"+([A-Z0-9\"(`])"


def js_trim_sql(e: str) -> str:
    return f"regexp_replace({e}, {Q.q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def split_sql(e: str) -> str:
    """DuckDB's RE2 has no look-around: mark each boundary with chr(1) (boundaries cannot overlap) and split."""
    marked = f"regexp_replace({e}, {Q.q(SPLIT_RE)}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: {js_trim_sql('x')} <> '')"


def urls_sql(e: str) -> str:
    return (f"list_transform(regexp_extract_all({e}, {Q.q('(' + X.URL_IN_TEXT_PATTERN + ')')}, 1), "
            f"lambda u: regexp_replace(u, {Q.q(X.URL_TRAILING_PUNCT_PATTERN)}, ''))")


URL_SHA_SQL = "url_sha as (select url, sha256(html) as content_sha256 from pages)"
PROV_SQL = f"prov as (select sha256(body) as content_sha256 from crawl where {TRIAGE_SQL} is null)"


def url_sha(spark, sf_dir):
    """The url -> sha map: every page's url with the sha of its html."""
    return read(spark, sf_dir, "pages", "url", "html").select("url", X.sha256_hex("html").alias("content_sha256"))


def provenance(spark, sf_dir):
    """Provenance shas: the bodies of crawl rows whose fetch was usable."""
    c = C.triage(FX.crawl(spark, sf_dir), max_bytes=FX.CRAWL_MAX_BYTES).filter(F.col("reason").isNull())
    return c.select(X.sha256_hex("body_text").alias("content_sha256"))


#: Texts go by a row number, so that those without id, or with the same, don't mix. Every cited url is judged once.
_JUDGED_SQL = f"""m as materialized (select url, max(content_sha256) as content_sha256 from url_sha group by url),
tracked as materialized (select url from m where content_sha256 <> '' and content_sha256 in (select content_sha256 from prov)),
cite as materialized (select rid, pos, unnest({urls_sql('sentence')}) as url from sent where contains(sentence, 'http')),
bad as materialized (select distinct c.rid, c.pos from cite c anti join tracked t on t.url = c.url)"""


def _sent_sql(docs: str) -> str:
    return f"""texts as materialized (select row_number() over () as rid, * from {docs}),
sent as materialized (select rid, unnest(parts) as sentence, unnest(range(len(parts))) as pos
  from (select rid, {split_sql('text')} as parts from texts))"""


def _filter_sql(docs_cte: str, docs: str) -> str:
    return FX.with_ctes(FX.CRAWL_SQL, URL_SHA_SQL, PROV_SQL, docs_cte, _sent_sql(docs), _JUDGED_SQL) + f""",
kept as (select s.rid, s.pos, s.sentence from sent s anti join bad b on b.rid = s.rid and b.pos = s.pos),
agg as (select rid, string_agg(sentence, ' ' order by pos) as joined from kept group by rid)
select a.doc_id, case when length(a.text) = 0 then a.text else {js_trim_sql("coalesce(g.joined, '')")} end as filtered
from texts a left join agg g on g.rid = a.rid"""


@register("sentence_split", f"""select doc_id, cast(pos as bigint) as pos, sentence from (select doc_id,
 unnest(parts) as sentence, unnest(range(len(parts))) as pos from (select doc_id, {split_sql('text')} as parts from documents))""")
def sentence_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence")) \
        .select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@register("url_extract", FX.with_ctes(FX.ANS_SQL) + f""", sent as (select doc_id, unnest(parts) as sentence,
 unnest(range(len(parts))) as pos from (select doc_id, {split_sql('text')} as parts from ans)),
us as (select doc_id, pos, {urls_sql('sentence')} as urls from sent)
select doc_id, cast(pos as bigint) as pos, cast(url_pos as bigint) as url_pos, url from (select doc_id, pos,
 unnest(urls) as url, unnest(range(len(urls))) as url_pos from us)""")
def url_extract(spark, sf_dir):
    c = CI.cited_urls(FX.answers(spark, sf_dir))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("url_pos").cast("long").alias("url_pos"),
                    "url")


@register("post_filter", _filter_sql(FX.ANS_SQL, "ans"))
def post_filter(spark, sf_dir):
    out = CI.post_filter(FX.answers(spark, sf_dir), url_sha(spark, sf_dir), provenance(spark, sf_dir))
    return out.select("doc_id", "filtered")


@register("post_filter_documents", _filter_sql(f"docs as materialized ({FX.cited_sql('documents', 's.doc_id', 's.doc_id')})", "docs"))
def post_filter_documents(spark, sf_dir):
    docs = FX.cited(read(spark, sf_dir, "documents", "doc_id", "text"), spark, sf_dir, "doc_id")
    out = CI.post_filter(docs, url_sha(spark, sf_dir), provenance(spark, sf_dir))
    return out.select("doc_id", "filtered")


@register("post_filter_drop_counts", FX.with_ctes(FX.CRAWL_SQL, URL_SHA_SQL, PROV_SQL, FX.ANS_SQL, _sent_sql("ans"), _JUDGED_SQL) + f""",
per as (select rid, count(*) as n_sentences, count(*) filter (where len({urls_sql('sentence')}) > 0) as n_url_sentences
  from sent group by rid),
dropped as (select rid, count(*) as n from bad group by rid)
select a.doc_id, coalesce(p.n_sentences, 0) as n_sentences, coalesce(p.n_url_sentences, 0) as n_url_sentences,
 coalesce(b.n, 0) as n_dropped from texts a left join per p on p.rid = a.rid left join dropped b on b.rid = a.rid""")
def post_filter_drop_counts(spark, sf_dir):
    return CI.drop_counts(FX.answers(spark, sf_dir), url_sha(spark, sf_dir), provenance(spark, sf_dir))


@register("post_filter_conversations", "select doc_id[1] as conv_id, doc_id[2] as turn, filtered from (" + _filter_sql(
    f"docs as ({FX.cited_sql('conversations', '[s.conv_id, s.turn] as doc_id', 's.conv_id + s.turn')})", "docs") + ")")
def post_filter_conversations(spark, sf_dir):
    """Every conversation turn, whole text, through the citation filter, keyed by conversation and turn."""
    c = FX.cited(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), spark, sf_dir, "conv_id + turn")
    docs = c.select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    out = CI.post_filter(docs, url_sha(spark, sf_dir), provenance(spark, sf_dir))
    return out.select("doc_id.conv_id", "doc_id.turn", "filtered")
