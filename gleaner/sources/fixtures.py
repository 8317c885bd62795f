"""Derived input tables for the registered queries.

The driver tables contain no allowlist, crawl outcomes, request envelopes or cited prose, so these are derived
from ``pages`` and ``events`` by fixed rules. Each derivation exists twice: a Spark builder (DataFrame API)
and the same rule as SQL text for the DuckDB oracle (``*_SQL``, used as CTEs). All rows of the driver
tables are kept; the rules only assign values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import allowlist as allowlist_source
from .tables import read

# The test allowlist (on-list example.com and example.org, off-list example.net, and a nested
# entry so the longest match matters).
AL_ROWS = [
    ("example.com", "broad", "generic", "2026-05-13"),
    ("example.org", "fast", "airline", "2026-05-13"),
    ("spam-farm.example.org", "narrow", "insurance-med", "2026-05-13"),
]
VALID_TRACE_ID = "0b1c2d3e-4f50-7a6b-9c7d-8e9fa0b1c2d3"
# events request the page with page_id = event_id % (number of pages): every page is requested, ~events/pages
# times each, at every scale; every fourth request goes to the page's failure row instead
CRAWL_MAX_BYTES = S.MAX_BODY_BYTES
FAILURE_MARK = "?f=1"  # ends the url of a page's failure row
SIGN_IN_HTML = ("<html><head><title>Sign in to the reading room</title></head><body><main><h2>Members</h2>"
                "<p>This shelf is for members.</p></main></body></html>")
CAPTCHA_HTML = ("<html><head><title>One moment</title></head><body><main><p>The shelf opens when Cloudflare "
                "Ray ID: 77aa has been checked.</p></main></body></html>")
TINY_HTML = "<html><head><title>stub</title></head><body><main>nothing yet</main></body></html>"
NOW_ISO = "2024-02-01T00:00:00.000Z"  # the fixed "now" of the pipeline queries


def allowlist(spark: SparkSession) -> DataFrame:
    """The test allowlist."""
    return allowlist_source.from_rows(spark, AL_ROWS)


def crawl(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """Two crawl results per page: the page itself, and a failure row (negative page_id, marked url) whose kind
    goes round all triage and quality reasons. Oversize bodies repeat the page past the cap. ``with_id``: also ``fetch_id``,
    which is unique whatever the pages hold (the page's place in its file)."""
    p = read(spark, sf_dir, "pages", "page_id", "url", "html", *(["_metadata.file_path", "_metadata.row_index"] if with_id else []))
    ids = [[F.struct("file_path", "row_index", F.lit(bad).alias("failed")).alias("fetch_id")] if with_id else [] for bad in (False, True)]
    kind = F.col("page_id") % 10
    html_type = F.lit("text/html; charset=utf-8")
    real = p.select("page_id", "url", F.when(kind == 6, 301).otherwise(200).alias("status"),
                    F.when(F.col("page_id") % 11 != 6, html_type).alias("content_type"), F.col("html").alias("body"),
                    F.lit(None).cast("string").alias("error_name"), *ids[0])
    times = F.expr(f"cast({CRAWL_MAX_BYTES} / greatest(octet_length(html), 1) as int) + 1")
    body = (F.when(kind.isin(3, 4), F.lit(None)).when(kind == 0, F.lit(SIGN_IN_HTML)).when(kind == 1, F.lit(CAPTCHA_HTML))
            .when(kind == 2, F.lit(TINY_HTML)).when(kind == 8, F.repeat(F.col("html"), times)).otherwise(F.col("html")))
    failed = p.select((-F.col("page_id") - 1).alias("page_id"), F.concat("url", F.lit(FAILURE_MARK)).alias("url"),
                      F.when(kind.isin(3, 4), 0).when(kind == 5, 403).otherwise(200).alias("status"),
                      F.when(kind == 6, F.lit("application/pdf")).when(kind == 9, F.lit(""))
                      .when(~kind.isin(3, 4, 7), html_type).alias("content_type"), body.alias("body"),
                      F.when(kind == 3, F.lit("AbortError")).when(kind == 4, F.lit("ECONNREFUSED")).alias("error_name"), *ids[1])
    return real.unionByName(failed).select(
        "page_id", "url", F.col("status").cast("int").alias("status"), "content_type",
        F.encode("body", "UTF-8").alias("body"), "error_name", F.col("url").alias("final_url"), *(["fetch_id"] if with_id else []))


PIECE = 20_000  # bytes of a chunk
#: After how many chunks the body of a page's fetch fails, and how, by the rest of its number by 7.
BROKEN = {3: (2, "AbortError"), 5: (0, "ECONNRESET")}


def chunked_crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``crawl`` with bodies as chunks, some of which fail: (heads, chunks)."""
    c = crawl(spark, sf_dir).withColumnRenamed("page_id", "fetch_id")
    heads = c.withColumn("has_body", F.col("body").isNotNull()).drop("body")
    rest = F.abs("fetch_id") % 7
    fails = F.coalesce(*[F.when(rest == r, F.lit(at)) for r, (at, _) in BROKEN.items()])
    error = F.coalesce(*[F.when(rest == r, F.lit(name)) for r, (_, name) in BROKEN.items()])
    n = F.ceil(F.octet_length("body") / PIECE).cast("int")
    pieces = (c.where("body is not null").withColumn("fails", fails)
              .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n)))
              .where((F.col("chunk_no") < n) & (F.col("fails").isNull() | (F.col("chunk_no") < F.col("fails")))
                     | (F.col("chunk_no") == F.col("fails"))))
    good = F.col("fails").isNull() | (F.col("chunk_no") < F.col("fails"))
    part = F.call_function("substr", F.col("body"), F.col("chunk_no") * PIECE + 1, F.lit(PIECE))
    return heads, pieces.select("fetch_id", "chunk_no", F.when(good, part).alias("bytes"), F.when(~good, error).alias("error"))


#: Where a page's fetch ends, by the last digit of its number: pages further on (a chain 1, 2, 3 and a circle 5, 6).
REDIRECTS = {1: 1, 2: 1, 5: 1, 6: -1}
ELSEWHERE = "https://example.net/elsewhere"  # off the list, not crawled
OLD_HTML = "<html><head><title>old</title></head><body><main>an older copy</main></body></html>"


def redirecting_crawl(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """``crawl`` with redirects within each ten pages, and an older row (lower ``crawl_seq``) for every third page."""
    c = crawl(spark, sf_dir, with_id)
    digit = F.col("page_id") % 10
    shift = F.create_map(*[F.lit(x) for pair in REDIRECTS.items() for x in pair])
    target = read(spark, sf_dir, "pages", F.col("page_id").alias("t_page"), F.col("url").alias("t_url"))
    real = F.col("page_id") >= 0
    by = shift[digit.cast("int")]  # rows that go nowhere are dealt out by their own number, a NULL would gather them in one task
    goes = F.coalesce(real & by.isNotNull(), F.lit(False))
    c = c.join(target, (F.coalesce(F.when(goes, F.col("page_id") + by), "page_id") == F.col("t_page")) & goes, "left")
    final = (F.when(real & (digit == 7), F.concat("url", F.lit(FAILURE_MARK)))
             .when(real & (digit == 8), F.lit(ELSEWHERE)).otherwise(F.coalesce("t_url", "final_url")))
    now = c.withColumn("final_url", final).drop("t_page", "t_url").withColumn("crawl_seq", F.lit(1).cast("long"))
    old = now.where(real & (F.col("page_id") % 3 == 0)).withColumns(
        {"crawl_seq": F.lit(0).cast("long"), "body": F.encode(F.lit(OLD_HTML), "UTF-8"), "final_url": F.col("url")})
    return now.unionByName(old)


_DERIVED: dict = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derive an input table once per application and keep it as Parquet under ``spark.checkpoint.dir``
    (request logs are stored inputs; deriving them is not part of the jobs that read them)."""
    from ..session import materialize

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        _DERIVED[key] = materialize(build(), name)
    return _DERIVED[key]


def heads_and_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newer rows of ``redirecting_crawl`` as heads (without body) and bodies (``fetch_id, url, body``): what is worked out
    for a head, like where its fetch ended, does not move its body."""
    heads = redirecting_crawl(spark, sf_dir, with_id=True).where("crawl_seq = 1").drop("crawl_seq", "page_id", "body")
    return heads, crawl(spark, sf_dir, with_id=True).select("fetch_id", "url", "body")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log derived from ``events`` (stored once per application, see ``_stored``)."""
    return _stored(spark, sf_dir, "request-log", lambda: derive_requests(spark, sf_dir))


def derive_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log from ``events``; error events carry a bad trace_id. Arrival order = (ts, seq)."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    p = read(spark, sf_dir, "pages", "page_id", "url")
    n_pages = _page_count(spark, sf_dir)
    et = F.col("event_type")
    url = F.coalesce("url", F.lit(""))  # an event without page asks for no url
    return (e.join(p, F.col("page_id") == F.col("event_id") % F.lit(n_pages), "left")
            .select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                    F.concat(F.lit("task:"), F.col("user_id").cast("string")).alias("source_ref"),
                    F.when(et.isin("view", "purchase"), "web.search.v1").otherwise("web.fetch.v1").alias("contract_id"),
                    F.when(et == "signup", "realtime").otherwise("cached").alias("freshness"),
                    F.when(et == "error", "not-a-uuid").otherwise(VALID_TRACE_ID).alias("trace_id"),
                    F.when(F.col("event_id") % 4 == 1, F.concat(url, F.lit(FAILURE_MARK))).otherwise(url).alias("url"),
                    "event_type", "user_id",
                    F.concat(F.lit("agent:"), (F.col("user_id") % 7).cast("string")).alias("caller_agent_id"),
                    F.concat(F.lit("pages about "), F.col("user_id").cast("string")).alias("query"),
                    (F.lit(1) + F.col("event_id") % 10).cast("int").alias("top_n")))


_COUNTS: dict = {}


def _page_count(spark: SparkSession, sf_dir: str) -> int:
    """Row count of ``pages`` (a scalar from Parquet metadata-backed count), memoized per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _COUNTS:
        _COUNTS[key] = max(read(spark, sf_dir, "pages").count(), 1)
    return _COUNTS[key]


def numbered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log with ``number``: its place, from 0, in order of arrival (counted per range of the order)."""
    def build():
        from ..session import materialize

        log = materialize(requests(spark, sf_dir).repartitionByRange("ts", "seq").withColumn("part", F.spark_partition_id()),
                          "request-log-parts")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = (log.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
                  .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
        inside = F.row_number().over(Window.partitionBy("part").orderBy("ts", "seq"))
        return log.join(starts, "part").withColumn("number", F.col("start") + inside - 1).drop("part", "start")

    return _stored(spark, sf_dir, "request-log-numbered", build)


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One NDJSON envelope line per request, with malformed, invalid and edge-case lines mixed in by rule
    (stored once per application)."""
    return _stored(spark, sf_dir, "request-lines",
                   lambda: requests(spark, sf_dir).select("seq", "ts", F.expr(LINE_EXPR).alias("value")))


def cited(texts: DataFrame, spark: SparkSession, sf_dir: str, id_expr: str) -> DataFrame:
    """``texts`` with four sentences after every text (column ``text``): one cites a page, one a made-up url, one
    both, one none. The page goes by ``id_expr``; a text that finds no page gets the last sentence only."""
    n = _page_count(spark, sf_dir)
    p = read(spark, sf_dir, "pages", F.col("page_id").alias("p_page"), F.col("url").alias("p_url"))
    j = texts.withColumn("p_page", F.expr(f"pmod({id_expr}, {n})")).join(p, "p_page", "left")
    cites = F.concat(F.lit(". Noted at "), "p_url", F.lit(". Claimed at https://made-up.example/"),
                     F.col("p_page").cast("string"), F.lit(". Both "), "p_url",
                     F.lit(" and https://made-up.example/b say so"))
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce(cites, F.lit("")), F.lit(". Nothing is cited here."))
    return j.withColumn("text", text).drop("p_page", "p_url")


def cited_sql(source: str, columns: str, id_expr: str) -> str:
    """The same rule over ``source``, keeping ``columns``."""
    return f"""select {columns}, concat(coalesce(s.text, ''), case when p.url is not null then concat('. Noted at ', p.url,
 '. Claimed at https://made-up.example/', cast(p.page_id as varchar), '. Both ', p.url,
 ' and https://made-up.example/b say so') end, '. Nothing is cited here.') as text
from {source} s left join pages p on p.page_id = ({id_expr}) % (select count(*) from pages)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated text with tracked, hallucinated and mixed citations, one per page."""
    p = read(spark, sf_dir, "pages", "page_id", "url")
    return p.select(
        F.col("page_id").alias("doc_id"),
        F.concat(F.lit("Fact one is plain. See "), F.col("url"), F.lit(". Also https://hallucinated.example/"),
                 F.col("page_id").cast("string"), F.lit(" agrees, they say. Both ("), F.col("url"),
                 F.lit(") and https://example.com/none differ. Plain end.")).alias("text"))


def site_filter():
    """The site filter of a search request, by its number."""
    s = F.col("seq")
    return (F.when(s % 7 == 3, F.array(F.lit("example.com"), F.lit("www.example.com")))
            .when(s % 7 == 5, F.array(F.lit("example.net"), F.lit("example.com")))
            .when(s % 11 == 6, F.array(F.lit("EXAMPLE.org")))
            .otherwise(F.lit(None).cast("array<string>")))


# ---------------------------------------------------------------------------------------------------
# The same derivations as SQL text (DuckDB dialect) for oracle_sql().
# ---------------------------------------------------------------------------------------------------
AL_SQL = """al as (select * from (values (0,'example.com','broad','generic','2026-05-13'),
 (1,'example.org','fast','airline','2026-05-13'),
 (2,'spam-farm.example.org','narrow','insurance-med','2026-05-13')) t(entry_index,domain,purpose,ttl_class,added_at))"""

CRAWL_SQL = f"""crawl as (select *, url as final_url from (
 select page_id, url, case when page_id % 10 = 6 then 301 else 200 end as status,
  case when page_id % 11 <> 6 then 'text/html; charset=utf-8' end as content_type, html as body,
  cast(null as varchar) as error_name from pages
 union all
 select -page_id - 1, url || '{FAILURE_MARK}', case when page_id % 10 in (3, 4) then 0 when page_id % 10 = 5 then 403 else 200 end,
  case when page_id % 10 in (3, 4, 7) then null when page_id % 10 = 6 then 'application/pdf' when page_id % 10 = 9 then ''
       else 'text/html; charset=utf-8' end,
  case page_id % 10 when 3 then null when 4 then null when 0 then '{SIGN_IN_HTML}' when 1 then '{CAPTCHA_HTML}'
       when 2 then '{TINY_HTML}' when 8 then repeat(html, cast(floor({CRAWL_MAX_BYTES} / greatest(strlen(html), 1)) as int) + 1)
       else html end,
  case page_id % 10 when 3 then 'AbortError' when 4 then 'ECONNREFUSED' end
 from pages))"""

_SHIFT = " ".join(f"when {d} then {k}" for d, k in REDIRECTS.items())
#: To be used after ``CRAWL_SQL``, whose rows it takes; only the latest row of each url is left.
REDIRECTING_SQL = CRAWL_SQL.replace("crawl as", "plain_crawl as", 1) + f""",
crawl as (select c.* exclude (final_url), case when c.page_id >= 0 and c.page_id % 10 = 7 then c.url || '{FAILURE_MARK}'
  when c.page_id >= 0 and c.page_id % 10 = 8 then '{ELSEWHERE}' else coalesce(t.url, c.final_url) end as final_url
 from plain_crawl c left join pages t on c.page_id >= 0 and t.page_id = c.page_id + case c.page_id % 10 {_SHIFT} end)"""

REQ_SQL = f"""req as (select e.event_id as seq, cast(e.ts as timestamp) as ts,
 concat('task:', cast(e.user_id as varchar)) as source_ref,
 case when e.event_type in ('view','purchase') then 'web.search.v1' else 'web.fetch.v1' end as contract_id,
 case when e.event_type = 'signup' then 'realtime' else 'cached' end as freshness,
 case when e.event_type = 'error' then 'not-a-uuid' else '{VALID_TRACE_ID}' end as trace_id,
 case when e.event_id % 4 = 1 then coalesce(p.url, '') || '{FAILURE_MARK}' else coalesce(p.url, '') end as url, e.event_type, e.user_id, concat('agent:', cast(e.user_id % 7 as varchar)) as caller_agent_id,
 concat('pages about ', cast(e.user_id as varchar)) as query, cast(1 + e.event_id % 10 as integer) as top_n
from events e left join pages p on p.page_id = e.event_id % (select count(*) from pages))"""

ANS_SQL = """ans as (select page_id as doc_id, concat('Fact one is plain. See ', url, '. Also https://hallucinated.example/',
 cast(page_id as varchar), ' agrees, they say. Both (', url, ') and https://example.com/none differ. Plain end.') as text
from pages)"""


# The NDJSON line rule, one SQL expression valid in both Spark SQL and DuckDB.
LINE_EXPR = """case
 when seq % 97 = 3 then 'not-json'
 when seq % 89 = 5 then '{"contract_id": 5}'
 when seq % 83 = 7 then '{"contract_id": "web.crawl.v1"}'
 when seq % 79 = 11 then '{"contract_id": "web.fetch.v1"} x'
 when seq % 73 = 13 then '[1, 2]'
 when seq % 67 = 17 then '   '
 when seq % 71 = 19 then 'null'
 else concat('{"contract_id": "', contract_id, '", "trace_id": "', trace_id, '", "dedupe_key": "d', cast(seq as string),
   '", "source_ref": "', source_ref, '", "caller_agent_id": "', caller_agent_id, '", ',
   case when contract_id = 'web.search.v1' then concat(
     '"query": "', case when seq % 61 = 19 then 'x' when seq % 59 = 23 then '  ' else query end,
     '", "top_n": ', case when seq % 53 = 29 then '25' when seq % 47 = 31 then '5.0' when seq % 43 = 7 then '"3"'
                          else cast(top_n as string) end,
     ', "freshness": "', case when seq % 41 = 37 then 'hourly' else 'week' end, '"',
     case when seq % 37 = 3 then ', "site_filter": ["example.com", "www.example.org"]'
          when seq % 31 = 5 then ', "site_filter": ["example.net"]'
          when seq % 29 = 7 then ', "site_filter": ["example.com", "example.com"]' else '' end)
   else concat('"url": "', url, '", "freshness": "', freshness, '"',
     case when seq % 23 = 7 then ', "max_bytes": 500' when seq % 19 = 3 then ', "max_bytes": 4096'
          when seq % 17 = 5 then ', "extra": true' else '' end) end,
   '}')
end"""

LINES_SQL = f"lines as (select seq, ts, {LINE_EXPR} as value from req)"


SITE_FILTER_SQL = ("case when seq % 7 = 3 then ['example.com', 'www.example.com'] when seq % 7 = 5 then "
                   "['example.net', 'example.com'] when seq % 11 = 6 then ['EXAMPLE.org'] end")


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
