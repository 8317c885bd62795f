"""Stateful per-task budget on an unbounded request stream.

``groupBy(source_ref).applyInPandasWithState``: the state per key is the number of ops already admitted
(<= cap), kept in the state store and restored from the checkpoint after a restart (the service's in-memory
counter is lost on restart; here it survives). Within a micro-batch the ``cap - used`` smallest (ts, seq) of a
key are admitted, found as a streaming top-k over the key's Arrow chunks: each chunk keeps only its own k
smallest as candidates and emits the rest as denied at once; candidates displaced later are emitted as denied
then. Memory per key is one chunk plus ``cap`` rows, however hot the key (a row outside the k smallest seen so
far can never be admitted later, so emitting it early is exact).

Arrival order across micro-batches is file order; within one, it comes from the (ts, seq) columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas as S

OUTPUT_SCHEMA = "seq long, source_ref string, budget_ok boolean"
STATE_SCHEMA = "used int"


def _budget_fn(cap: int):
    def fn(key, pdfs, state):
        import numpy as np
        import pandas as pd

        used = state.get[0] if state.exists else 0
        left = max(cap - used, 0)
        src = key[0]
        cand_ts = np.empty(0, dtype=np.int64)
        cand_seq = np.empty(0, dtype=np.int64)
        total = 0

        def out(seqs, ok):
            return pd.DataFrame({"seq": np.asarray(seqs, dtype=np.int64), "source_ref": src,
                                 "budget_ok": np.full(len(seqs), ok, dtype=bool)})

        for pdf in pdfs:
            total += len(pdf)
            ts = pd.to_datetime(pdf["ts"]).to_numpy(dtype="datetime64[us]").astype(np.int64)
            seq = pdf["seq"].to_numpy(dtype=np.int64)
            order = np.lexsort((seq, ts))
            keep, drop = order[:left], order[left:]
            if len(drop):
                yield out(seq[drop], False)
            all_ts = np.concatenate([cand_ts, ts[keep]])
            all_seq = np.concatenate([cand_seq, seq[keep]])
            o = np.lexsort((all_seq, all_ts))
            if len(o) > left:
                yield out(all_seq[o[left:]], False)
            cand_ts, cand_seq = all_ts[o[:left]], all_seq[o[:left]]
        if len(cand_seq):
            yield out(cand_seq, True)
        state.update((min(cap, used + total),))

    return fn


def budget_stream(valid_requests: DataFrame, cap: int = S.OPS_PER_TASK) -> DataFrame:
    """Streaming DataFrame ``seq, source_ref, budget_ok`` from a streaming DataFrame of valid requests
    (``seq, ts, source_ref``; NULL source_ref is unlimited: admitted, and bypasses the state)."""
    keyed = valid_requests.filter("source_ref is not null").select("seq", "ts", "source_ref")
    counted = keyed.groupBy("source_ref").applyInPandasWithState(
        _budget_fn(cap), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    unlimited = valid_requests.filter("source_ref is null").selectExpr("seq", "source_ref", "true as budget_ok")
    return counted.unionByName(unlimited)
