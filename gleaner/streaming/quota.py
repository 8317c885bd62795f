"""Declared quotas on a stream (D4, D5): so many operations a UTC day, so many searches a month.

Two levels. Each task of a micro-batch holds back, per period, the ``cap`` earliest rows that it sees and lets the rest go
as over the quota, since ``cap`` rows of the same task precede them. What was held back (at most ``cap`` rows a task and
period) goes to the period's state, a typed ``transformWithState`` value that tells how much is used up, and the earliest
that still fit are within. So a period with all rows of a batch sends no more than ``cap`` rows a task to its state, and
the others are dealt out by a salt. A period's state is one number, kept for good: a few hundred a year.

Order within a micro-batch is (ts, seq); across micro-batches it is the order in which the source brings them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S

ORDER = ["ts", "seq"]
SALTS = 64
OUTPUT = "seq long, period string, within boolean"
_MARKED = pa.schema([("period", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("seq", pa.int64()), ("salt", pa.int32())])


def _hold_back(cap: int):
    """Add ``salt``: 0 for a task's ``cap`` earliest rows of each period, 1 to SALTS for the others."""

    def marked(rows: pd.DataFrame, salt) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(rows.assign(salt=np.asarray(salt, np.int32)), schema=_MARKED, preserve_index=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = b.to_pandas()
            seen = (rows if held is None else pd.concat([held, rows])).sort_values(ORDER, kind="stable")
            early = seen.groupby("period", sort=False, dropna=False).cumcount() < cap
            held, rest = seen[early], seen[~early]
            if len(rest):
                yield marked(rest, np.arange(len(rest)) % SALTS + 1)
        if held is not None and len(held):
            yield marked(held, np.zeros(len(held)))

    return work


class Quota(StatefulProcessor):
    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n int", None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        def told(part: pd.DataFrame, within: bool) -> pd.DataFrame:
            return part[["seq", "period"]].assign(within=within)

        if key[1]:
            for chunk in rows:
                yield told(chunk, False)
            return
        before = self.used.get()[0] if self.used.exists() else 0
        left, first = max(self.cap - before, 0), None
        for chunk in rows:
            seen = (chunk if first is None else pd.concat([first, chunk])).sort_values(ORDER, kind="stable")
            first = seen.iloc[:left]
            if len(seen) > left:
                yield told(seen.iloc[left:], False)
        if first is not None and len(first):
            self.used.update((before + len(first),))
            yield told(first, True)

    def close(self) -> None:
        pass


def quota_stream(rows: DataFrame, period: Column, cap: int) -> DataFrame:
    """Streaming ``seq, period, within`` for every row (``seq, ts``) of a stream: the first ``cap`` of each period are
    within. To be started by ``session.start_stateful``."""
    marked = (rows.select(period.alias("period"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
              .mapInArrow(_hold_back(cap), "period string, ts timestamp, seq long, salt int"))
    return marked.groupBy("period", "salt").transformWithStateInPandas(Quota(cap), OUTPUT, "Append", "None")


def daily_cap(ops: DataFrame, cap: int = S.OPS_PER_DAY) -> DataFrame:
    """``quota_stream`` per UTC day."""
    return quota_stream(ops, F.date_format("ts", "yyyy-MM-dd"), cap)


def monthly_spend(searches: DataFrame, usd_per_search: str = S.USD_PER_SEARCH, budget_usd: str = S.BUDGET_USD_MONTH) -> DataFrame:
    """``quota_stream`` per UTC month: as many searches as the budget pays for."""
    return quota_stream(searches, F.date_format("ts", "yyyy-MM"), int(Decimal(budget_usd) / Decimal(usd_per_search)))


def dedupe(keyed: DataFrame, key_col: str = "dedupe_key", ts_col: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Declared dedupe on a stream (D1): one row per key. Repeats are dropped until the watermark (latest event time less
    ``horizon``) has passed the row that was kept by ``horizon``; then its state goes and the key is new again. Rows that
    come later than the watermark are dropped, too. ``key_mismatches`` in ``operators.requests`` reports keys that differ."""
    return keyed.withWatermark(ts_col, horizon).dropDuplicatesWithinWatermark([key_col])
