"""Citation post-filter (O22-O24, O41): drop every sentence that cites a URL without provenance.

A URL is tracked iff it is in the url -> sha map by exact string, its sha is non-empty, and the sha has a
provenance row. A sentence is kept iff every URL in it is tracked; sentences without URLs are kept. Kept
sentences are rejoined in order with one space and trimmed; an empty text is returned as is.

Plan (designed so text never moves unless it has to):
1. sentences and their URLs are computed per row (narrow: split + regexp_extract_all);
2. the url map, reduced to one sha per url, semi-joined with provenance gives the tracked URLs;
3. citations without a tracked URL (anti-join; one split pass, a hot URL is an ordinary skewed join key) give
   the sentences to drop, collected per text (bounded by that text's sentence count). What is dropped depends on the
   text alone, so texts go by a 128-bit hash: documents without id, or with the same id, don't mix;
4. documents are joined with their drop positions and the kept sentences are re-joined by a per-row filter.
   No broadcast hint: with AQE on, Spark measures the drop table's real shuffle size at runtime and turns the
   join into a broadcast only under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond it the join stays
   a shuffle join on the hash (skewed partitions split by AQE). The drop table is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

def cited_urls(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, url_pos, url): every URL of every sentence, positions 0-based."""
    s = docs.select(F.col(doc_col).alias("doc_id"),
                    F.posexplode(X.split_sentences(F.col(text_col))).alias("pos", "sentence"))
    return s.select("doc_id", "pos", F.posexplode(X.extract_urls(F.col("sentence"))).alias("url_pos", "url"))


def tracked_urls(url_sha: DataFrame, provenance: DataFrame) -> DataFrame:
    """(url) of the map whose sha is not empty and has a provenance row."""
    shamap = url_sha.groupBy("url").agg(F.max("content_sha256").alias("content_sha256"))
    return (shamap.filter(F.col("content_sha256") != "")
            .join(provenance.select("content_sha256"), "content_sha256", "left_semi").select("url"))


_KEY = ["__gl_key1", "__gl_key2"]


def _text_key(text_col: str) -> dict:
    return {_KEY[0]: F.xxhash64(text_col), _KEY[1]: F.xxhash64(F.lit(1), text_col)}


def drop_positions(docs: DataFrame, url_sha: DataFrame, provenance: DataFrame, text_col="text") -> DataFrame:
    """Sentence positions to drop (``drop``, array<int>) per hash of a text, only for texts with any.
    A text without the substring ``http`` cannot cite a URL, so only the others are split (exact pre-filter)."""
    keyed = (docs.filter(F.col(text_col).contains("http")).withColumns(_text_key(text_col))
             .select(F.struct(*_KEY).alias("doc_id"), text_col))
    bad = cited_urls(keyed, "doc_id", text_col).join(tracked_urls(url_sha, provenance), "url", "left_anti")
    return (bad.groupBy(*[F.col(f"doc_id.{k}").alias(k) for k in _KEY])
            .agg(F.array_sort(F.collect_set("pos")).alias("drop")))


def post_filter(docs: DataFrame, url_sha: DataFrame, provenance: DataFrame, text_col: str = "text",
                out_col: str = "filtered") -> DataFrame:
    """Add ``out_col``: the text with every sentence that cites an untracked URL removed (NULL stays NULL)."""
    j = (docs.withColumns(_text_key(text_col))
         .join(drop_positions(docs, url_sha, provenance, text_col), _KEY, "left"))
    kept = F.filter(X.split_sentences(F.col(text_col)), lambda s, i: ~F.array_contains(F.col("drop"), i))
    # nothing dropped: joining the pieces with one space is the same as replacing each boundary by one space
    # (pieces are never blank: each holds the boundary's punctuation or capital), so use one regex pass
    whole = X.js_trim(F.regexp_replace(F.col(text_col), X.SENTENCE_SPLIT_PATTERN, " "))
    out = (F.when(F.length(text_col) == 0, F.col(text_col))
           .when(F.col("drop").isNull(), whole)
           .otherwise(X.js_trim(F.array_join(kept, " "))))
    return j.withColumn(out_col, out).drop(*_KEY, "drop")


def drop_counts(docs: DataFrame, url_sha: DataFrame, provenance: DataFrame, doc_col="doc_id",
                text_col="text") -> DataFrame:
    """Per document: sentences, sentences citing URLs, sentences dropped."""
    sents = X.split_sentences(F.col(text_col))
    n_url = F.size(F.filter(sents, lambda s: F.size(X.extract_urls(s)) > 0))
    return (docs.withColumns(_text_key(text_col))
            .join(drop_positions(docs, url_sha, provenance, text_col), _KEY, "left")
            .select(F.col(doc_col).alias("doc_id"), F.size(sents).cast("long").alias("n_sentences"),
                    n_url.cast("long").alias("n_url_sentences"),
                    F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_dropped")))
