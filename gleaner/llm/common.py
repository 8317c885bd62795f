"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Multipliers of the 64-bit mixing step (odd numbers with well spread bits).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= MIX_A
    x ^= x >> np.uint64(29)
    x *= MIX_B
    x ^= x >> np.uint64(32)
    return x


def text_groups(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters in all (at least one text each)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def total_order(df: DataFrame, keys: list, measure: str | None = None, name: str = "order") -> DataFrame:
    """Every row's place in the global order by ``keys`` without gathering the rows in one task.

    Rows are range-partitioned by the keys and a row number that breaks ties between equal rows (so a key
    that holds many rows is spread), written once, counted per partition, and the per-partition totals (one
    row each) are turned into prefix sums that the rows add to their own partition's running sums. Adds
    ``_rank`` (from 0), ``_before`` (sum of ``measure`` over all earlier rows) and ``_total`` (its whole sum).
    """
    measured = F.col(measure) if measure else F.lit(0).cast("long")
    spread = (df.withColumn("_m", measured.cast("long")).withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(*keys, F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    rows = materialize(spread, name)
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = (rows.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_m").alias("_s"))
              .select("_part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_n0"),
                      F.coalesce(F.sum("_s").over(up_to), F.lit(0)).alias("_s0"),
                      F.sum("_s").over(whole).alias("_total")))
    inside = Window.partitionBy("_part").orderBy(*keys, "_tie")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.join(F.broadcast(starts), "_part")  # one row per shuffle partition
            .withColumn("_rank", F.col("_n0") + F.row_number().over(inside) - 1)
            .withColumn("_before", F.col("_s0") + F.sum("_m").over(running) - F.col("_m"))
            .drop("_m", "_tie", "_part", "_n0", "_s0"))
