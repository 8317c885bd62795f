"""Admission of request lines on a stream (O1 + O8 + O42 + O44): NDJSON files in, one code per line out.

Lines are read with their place in their file, parsed and validated as in the batch job, and the valid ones are counted
per task by ``transformWithState``: a typed value state holds how many requests of a task were admitted, is restored
from the checkpoint after a restart and, if asked, expires some time after the task's last admission (state TTL).

Within a micro-batch the first ``cap`` requests of a task in order of arrival are admitted. A row that ``cap`` rows of its
task precede within one Arrow batch can never be among them, so it is marked before the shuffle, and marked rows, like
lines that were refused before, are dealt out by a salt alone: of a task with a third of all rows at most ``cap`` rows per
Arrow batch meet in a task, and decided rows make ``SALTS`` groups of a micro-batch, however many tasks they belong to. The
state function keeps ``cap`` rows besides the chunk in hand.

Order of arrival across micro-batches is the order in which the file source takes up files (oldest first); within one it is
(ts, file_path, block_start, place), as in ``sources.requests``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..operators import requests as R
from ..session import start_stateful

ORDER = ["ts", "file_path", "block_start", "place"]
SALTS = 64
OUTPUT = "file_path string, block_start long, place long, source_ref string, code string"
_MARKED = pa.schema([("source_ref", pa.string()), ("code", pa.string()), ("ts", pa.timestamp("us", "UTC")),
                     ("file_path", pa.string()), ("block_start", pa.int64()), ("place", pa.int64()), ("salt", pa.int32())])


def _mark(cap: int):
    """Add ``salt``: 0 for rows that may be admitted, 1 to SALTS for the rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pandas()
            open_rows = rows[rows["code"].isna()].sort_values(ORDER, kind="stable")
            rank = open_rows.groupby("source_ref", sort=False, dropna=False).cumcount()
            salt = (np.arange(len(rows)) % SALTS + 1).astype(np.int32)
            salt[rank.index[rank.to_numpy() < cap]] = 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(salt)], schema=_MARKED)

    return work


def keyed(rows: DataFrame, cap: int) -> DataFrame:
    """Rows with the groups they are counted in, (``source_ref``, ``salt``): the task's for rows that may be admitted, for
    the others only a salt. ``ref`` keeps the task."""
    marked = rows.mapInArrow(_mark(cap), "source_ref string, code string, ts timestamp, file_path string, "
                                         "block_start long, place long, salt int")
    return marked.withColumns({"ref": F.col("source_ref"), "source_ref": F.when(F.col("salt") == 0, F.col("source_ref"))})


class TaskBudget(StatefulProcessor):
    """Admits the first ``cap`` requests of a task, over all micro-batches."""

    def __init__(self, cap: int, ttl_ms: int | None):
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source_ref, salt = key

        def told(part: pd.DataFrame, code) -> pd.DataFrame:
            return pd.DataFrame({"file_path": part["file_path"], "block_start": part["block_start"], "place": part["place"],
                                 "source_ref": part["ref"], "code": code})

        if salt:
            for chunk in rows:
                yield told(chunk, chunk["code"].where(chunk["code"].notna(), "budget_exhausted"))
            return
        if source_ref is None:  # no task, no budget
            for chunk in rows:
                yield told(chunk, "admitted")
            return
        used = self.used.get()
        before = used[0] if used else 0
        left = max(self.cap - before, 0)
        first = None
        for chunk in rows:
            if first is not None:  # the first ones so far, and what is new
                yield told(first.iloc[left:], "budget_exhausted")
                chunk = pd.concat([first.iloc[:left], chunk])
            if len(chunk) > 1:
                order = list(zip(*(chunk[c].tolist() for c in ORDER)))
                chunk = chunk.take(sorted(range(len(order)), key=order.__getitem__))
            first = chunk
        if first is not None and len(first):
            n = min(left, len(first))
            if n:
                self.used.update((before + n,))
            yield told(first, np.where(np.arange(len(first)) < n, "admitted", "budget_exhausted"))

    def close(self) -> None:
        pass


def admission_stream(lines: DataFrame, cap: int = S.OPS_PER_TASK, ttl_ms: int | None = None) -> DataFrame:
    """Streaming ``file_path, block_start, place, source_ref, code`` (``bad_query``, ``validation_failed``,
    ``budget_exhausted`` or ``admitted``) for every line that is not blank, from ``sources.requests.read_lines_stream``.
    ``ttl_ms``: a task's count is forgotten so long (processing time) after its last admission; default: never."""
    checked = R.validate(R.parse_lines(lines), keep_fields=True)
    refused = (F.when(F.col("parse_error").isNotNull(), F.lit("bad_query"))
               .when(~F.col("valid"), F.lit("validation_failed")))
    rows = checked.select(F.when(F.col("valid"), F.col("env_source_ref")).alias("source_ref"), refused.alias("code"), *ORDER)
    return keyed(rows, cap).groupBy("source_ref", "salt").transformWithStateInPandas(
        TaskBudget(cap, ttl_ms), OUTPUT, "Append", "ProcessingTime" if ttl_ms else "None")


def admit_files(lines: DataFrame, out: str, checkpoint: str, cap: int = S.OPS_PER_TASK, ttl_ms: int | None = None,
                available_now: bool = True):
    """Start the admission of a stream of lines into Parquet files at ``out``; returns the StreamingQuery."""
    return start_stateful(admission_stream(lines, cap, ttl_ms), out, checkpoint, available_now)
