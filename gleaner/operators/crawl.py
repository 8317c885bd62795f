"""Crawl-outcome triage (O12), body decode (O36) and declared per-call truncation (D3).

Input: a crawl table (``schemas.CRAWL``: url, status, content_type, body binary, error_name, final_url) --
the result of GETs done elsewhere, bodies whole or in chunks (``read_bodies``). Triage is one ``F.when`` chain, narrow, no
shuffle; ``octet_length`` is evaluated before any decode so oversize bodies are never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions import urls as U
from .ranges import running_sum


def one_per_url(crawl: DataFrame) -> DataFrame:
    """One row per requested url: the latest by ``crawl_seq`` if there is such a column, else a usable one before a
    failed one, then the lowest final url; ties: the row that hashes lower. Rows are ranked before the shuffle."""
    plain = [c for c, kind in crawl.dtypes if not kind.startswith(("map", "variant"))]
    order = [F.col("crawl_seq").desc_nulls_last()] if "crawl_seq" in crawl.columns else []
    order += [F.col("error_name").asc_nulls_first(), ((F.col("status") < 200) | (F.col("status") >= 400)).asc(),
              F.col("final_url").asc(), F.xxhash64(*plain)]
    return (crawl.withColumn("__gl_rank", F.row_number().over(Window.partitionBy("url").orderBy(*order)))
            .filter("__gl_rank = 1").drop("__gl_rank"))


def response_reason(status, content_type, error_name) -> Column:
    """First failing check before the body is read, in the service's order; NULL when the body is to be read."""
    st, ct, err = (F.col(c) if isinstance(c, str) else c for c in (status, content_type, error_name))
    ct = F.nullif(F.lower(ct), F.lit(""))  # an empty header is an absent one
    return (F.when(err.isNotNull(), _failure(err))
            .when((st < 200) | (st >= 400), F.lit("non_2xx"))
            .when(ct.isNotNull() & ~ct.startswith("text/html") & ~ct.startswith("application/xhtml"),
                  F.lit("invalid_content_type")))


def _failure(error: Column) -> Column:
    return F.when(error == "AbortError", F.lit("timeout")).otherwise(F.lit("transport_error"))


def triage_reason(status, content_type, body, error_name, max_bytes=S.MAX_BODY_BYTES) -> Column:
    """First failing check of a whole body in the service's order; NULL when the document is usable."""
    b = F.col(body) if isinstance(body, str) else body
    mb = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)
    return F.coalesce(response_reason(status, content_type, error_name),
                      F.when(b.isNull(), F.lit("transport_error")).when(F.octet_length(b) > mb, F.lit("over_size_cap")))


def read_bodies(heads: DataFrame, chunks: DataFrame, max_bytes: int = S.MAX_BODY_BYTES) -> DataFrame:
    """Bodies that arrived in chunks, read as the service reads them: up to the chunk that crosses ``max_bytes`` or fails.

    heads: crawl rows without body, ``fetch_id`` (unique) and ``has_body``; chunks: ``fetch_id, chunk_no, bytes, error``
    (the read of that chunk failed; 'AbortError' is the timeout). Returns the heads with ``body`` (NULL unless read to the
    end), ``body_reason`` (NULL, 'over_size_cap', 'timeout' or 'transport_error') and ``body_bytes`` (the count at that
    point), which ``triage`` takes. Chunks of responses that are not read are never looked at.

    The running counts are made over narrow rows, range-partitioned by (fetch, chunk) with one carried sum per partition, so
    a fetch of any number of chunks is spread; chunk bytes move only for the bodies that are kept, at most ``max_bytes`` each.
    """
    read = heads.where(F.col("has_body") & response_reason("status", "content_type", "error_name").isNull()).select("fetch_id")
    chunks = chunks.join(read, "fetch_id", "left_semi")
    counted = running_sum(chunks.select("fetch_id", "chunk_no", F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")
                                        .alias("size"), "error"), ["fetch_id"], ["chunk_no"], "size", "total")
    stop = F.when(F.col("error").isNotNull(), _failure(F.col("error"))).when(F.col("total") > max_bytes, F.lit("over_size_cap"))
    ends = (counted.withColumn("stop", stop).groupBy("fetch_id")
            .agg(F.min_by(F.struct("stop", (F.col("total") - F.when(F.col("error").isNotNull(), F.col("size")).otherwise(0))
                                   .alias("total")), F.when(F.col("stop").isNotNull(), F.col("chunk_no"))).alias("end"),
                 F.max("total").alias("all")))
    ends = ends.select("fetch_id", F.col("end.stop").alias("body_reason"), F.coalesce("end.total", "all").alias("body_bytes"))
    whole = chunks.join(ends.where("body_reason is null").select("fetch_id"), "fetch_id", "left_semi").where("bytes is not null")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", F.hex("bytes").alias("hex"))))
    bodies = whole.groupBy("fetch_id").agg(F.unhex(F.array_join(F.transform(parts, lambda c: c["hex"]), "")).alias("__gl_body"))
    empty = F.when(F.col("has_body") & F.col("body_reason").isNull(), F.unhex(F.lit("")))
    return (heads.join(ends, "fetch_id", "left").join(bodies, "fetch_id", "left")
            .withColumn("body", F.coalesce("__gl_body", empty)).drop("__gl_body"))


def triage(crawl: DataFrame, max_bytes=S.MAX_BODY_BYTES) -> DataFrame:
    """Add the fetched-document columns: ``doc_url, doc_origin, doc_status, doc_content_type, body_text,
    byte_size, low_signal, reason``. Failed requests keep the requested url; everything else, a body that fails on the
    way included, reports status and post-redirect url. Failures carry an empty body; ``byte_size`` is 0 before the body
    and the count so far within it. Without ``read_bodies`` a body over the cap counts as a whole."""
    reason = triage_reason("status", "content_type", "body", "error_name", max_bytes)
    size = F.octet_length("body").cast("long")
    counted = F.when(F.col("reason").isNull() | (F.col("reason") == "over_size_cap"), size)
    if "body_reason" in crawl.columns:
        before = response_reason("status", "content_type", "error_name")
        reason = F.coalesce(before, "body_reason", reason)
        counted = F.when(before.isNull() & F.col("body_reason").isNotNull(), F.col("body_bytes")).otherwise(counted)
    transport = F.col("error_name").isNotNull()
    final = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")) \
        if "final_url" in crawl.columns else F.col("url")
    requested_origin = U.origin(F.col("url"))
    return (crawl
            .withColumn("reason", reason)
            .withColumn("doc_url", F.when(transport, F.col("url")).otherwise(final))
            .withColumn("doc_origin", F.when(transport, requested_origin)
                        .otherwise(U.origin(final, requested_origin)))
            .withColumn("doc_status", F.when(transport, F.lit(0)).otherwise(F.col("status")).cast("int"))
            .withColumn("doc_content_type", F.when(transport, F.lit(None)).otherwise(F.lower("content_type")))
            .withColumn("low_signal", F.col("reason").isNotNull())
            .withColumn("byte_size", F.coalesce(counted, F.lit(0).cast("long")))
            .withColumn("body_text", F.when(F.col("reason").isNull(), X.decode_body(F.col("body")))
                        .otherwise(F.lit(""))))


def truncate_body(body, max_bytes) -> Column:
    """Declared per-call cap (D3): struct(text, kept_bytes, truncated). Truncation can cut a multi-byte
    character; the broken tail decodes to U+FFFD like any malformed input."""
    b = F.col(body) if isinstance(body, str) else body
    mb = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)
    size = F.octet_length(b)
    kept = F.when(size > mb, F.call_function("substr", b, F.lit(1), mb)).otherwise(b)
    return F.struct(X.decode_body(kept).alias("text"), F.octet_length(kept).cast("long").alias("kept_bytes"),
                    (size > mb).alias("truncated"))
