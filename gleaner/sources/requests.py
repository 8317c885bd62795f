"""Request-line source (O1): NDJSON files, one envelope per line, batch or streaming.

Arrival order comes from the files themselves: modification time, path, start of the file split, and the line's place in
its split. Blank-line skipping, the 1 MiB cap and strict JSON parsing happen in ``operators.requests.parse_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "value string, file_path string, ts timestamp, block_start bigint, place bigint"
_ARROW = pa.schema([("value", pa.string()), ("file_path", pa.string()), ("ts", pa.timestamp("us", "UTC")),
                    ("block_start", pa.int64()), ("place", pa.int64())])


def _count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A split's lines come in order and in one task: number them as they pass by."""
    split, before = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        path, block = b.column(1), b.column(3)
        new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1]))
        first = np.append(0, np.nonzero(new.to_numpy(zero_copy_only=False))[0] + 1)
        place = np.arange(b.num_rows) - np.repeat(first, np.diff(np.append(first, b.num_rows)))
        if (path[0].as_py(), block[0].as_py()) == split:
            end = first[1] if len(first) > 1 else b.num_rows
            place[:end] += before
        split, before = (path[-1].as_py(), block[-1].as_py()), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], schema=_ARROW)


def _with_place(df: DataFrame) -> DataFrame:
    lines = df.select("value", F.col("_metadata.file_path").alias("file_path"),
                      F.col("_metadata.file_modification_time").alias("ts"),
                      F.col("_metadata.file_block_start").cast("long").alias("block_start"))
    return lines.mapInArrow(_count_places, LINE)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch read: ``value, file_path, ts (file modification time), block_start, place`` (number of the line in its
    split). Ordered by ``(ts, file_path, block_start, place)`` the lines are in order of arrival."""
    return _with_place(spark.read.format("text").load(path))


#: Where files are cut within ``fixed_splits``.
SPLITS = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.maxPartitionBytes": "8m"}


@contextmanager
def fixed_splits(spark: SparkSession):
    """Reads that run within cut every file at the same bytes, whichever files they read with it. Else Spark sizes the splits
    by all files of a read and by the cores, so that a micro-batch and a batch read count their places from other bytes."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_starts(lines: DataFrame, order: tuple = ("ts", "file_path", "block_start")) -> DataFrame:
    """``file_path, block_start, start``: how many lines arrived before each split of ``read_lines``. Lines are counted
    per split (a few rows a gigabyte) and the counts are summed up in ``order``. To number rows of another read, run both
    within ``fixed_splits``."""
    key = ["file_path", "block_start"]
    counts = lines.groupBy(*key).agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def numbered_lines(lines: DataFrame, order: tuple = ("ts", "file_path", "block_start")) -> DataFrame:
    """``seq, ts, value`` from ``read_lines``: ``seq`` (long, from 0) is the line's number in order of arrival: what
    arrived before its split, and its place there."""
    found = lines.join(split_starts(lines, order), ["file_path", "block_start"])
    return found.select((F.col("start") + F.col("place")).alias("seq"), "ts", "value")


def read_lines_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of NDJSON files dropped into ``path``, oldest first (one micro-batch per set of new files): the
    columns of ``read_lines``."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _with_place(r.load(path))


def set_arrival(spark: SparkSession, path: str, first_ms: int, step_ms: int = 1000) -> None:
    """Make the files in a folder arrive in the order of their names: their modification times are set to ``first_ms``
    (since the epoch) and ``step_ms`` later for each further file."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if not f.getPath().getName().startswith(("_", "."))),
                   key=lambda f: f.getName())
    for i, f in enumerate(files):
        fs.setTimes(f, first_ms + step_ms * i, -1)


def write_lines(lines: DataFrame, path: str, value_col: str = "value") -> None:
    """Sink for NDJSON lines (text files)."""
    lines.select(F.col(value_col).alias("value")).write.mode("overwrite").text(path)
