"""Running sums per key without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sum(rows: DataFrame, key: list, order: list, measure: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``measure`` over the rows of the same key up to the row, in ``order`` (ties: either way).

    Rows are range-partitioned by key and order, and written once; each partition sums up its own rows, and per key
    and partition (one row, few keys are in more than one) the sums of the earlier partitions are added."""
    dealt = (rows.withColumn("__gl_tie", F.monotonically_increasing_id())
             .repartitionByRange(*key, *order, "__gl_tie").withColumn("__gl_part", F.spark_partition_id()))
    rows = materialize(dealt, "running-sum")
    earlier = Window.partitionBy(*key).orderBy("__gl_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "__gl_part").agg(F.sum(measure).alias("__gl_n"))
    sums = sums.select(*key, "__gl_part", F.coalesce(F.sum("__gl_n").over(earlier), F.lit(0)).alias("__gl_before"))
    inside = (Window.partitionBy(*key, "__gl_part").orderBy(*order, "__gl_tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(sums, [*key, "__gl_part"]).withColumn(out, F.col("__gl_before") + F.sum(measure).over(inside))
            .drop("__gl_before", "__gl_part", "__gl_tie"))
