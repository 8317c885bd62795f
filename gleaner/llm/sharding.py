"""Contiguous shards of nearly equal bytes from global prefix sums.

The documents are put in the order of their ids (ties: checksum, size). Per-partition byte totals are summed
into global prefix sums, and the order is cut where the running total passes equal targets, so each shard is a
contiguous range and differs from its target by less than one document at either end. Only ids, sizes and
checksums are shuffled, never texts. All on DataFrame functions.

Null text: no bytes of its own, checksum of the empty text. Null id: sorts first. Repeated rows: kept, each
with its own slot. Empty table: no rows. Extra columns: ignored. A document larger than a shard's target
stays whole; neighbouring shards may then be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import total_order


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 16) -> DataFrame:
    """One row per document: id, ``size`` (bytes of the text plus ``overhead``), ``text_crc32``, ``shard``
    (0 to ``n_shards`` - 1, ascending with the id) and ``slot`` (gapless from 0 within the shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"))
    placed = total_order(narrow, ["doc_id", "text_crc32", "size"], measure="size", name="shard-order")
    # the middle of the document decides, so that a cut falls on the nearer side of it
    middle = F.col("_before") * 2 + F.col("size")
    cut = F.expr("cast(_mid * {0} div (2 * _total) as int)".format(int(n_shards)))
    placed = (placed.withColumn("_mid", middle.cast("decimal(38,0)"))
              .withColumn("shard", F.least(F.lit(n_shards - 1), cut)))
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return (placed.join(F.broadcast(firsts), "shard")  # n_shards rows
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")))
