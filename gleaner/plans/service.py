"""The whole service over a table of request lines (O1, O8, O42, O14, O7): parse, validate, budget, dispatch to the
fetch or the search pipeline, one response line per request line.

Codes: ``bad_query``, ``validation_failed``, ``budget_exhausted`` from admission; the pipelines' own codes for the
rest. Arrival order is (ts, seq); seq is unique (``sources.requests.numbered_lines`` gives both).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import budgets as B
from ..operators import requests as R
from ..session import materialize
from . import fetch as FP
from . import search as SP

FIELDS = ["source_ref", "trace_id", "caller_agent_id", "query", "top_n", "url", "freshness", "site_filter"]


def admit(lines: DataFrame, fields: list) -> DataFrame:
    """parse -> validate -> per-task budget over the valid envelopes, in that order (O42): ``seq, ts, parse_error, valid,
    errors, contract_id_raw``, the asked envelope ``fields`` (``source_ref`` always), ``budget_ok`` and ``code``.

    The validated table is written once under the checkpoint folder: it is read twice (rank side and main side), and
    cutting the lineage stops the optimizer from inlining the rule expressions into pushed-down join filters."""
    fields = list(dict.fromkeys(["source_ref", *fields]))
    v = R.envelope_fields(R.validate(R.parse_lines(lines)))
    v = materialize(v.select("seq", "ts", "parse_error", "valid", "errors", "contract_id_raw", *fields), "validated-requests")
    first = (B.first_k_ids(v.filter("valid"), "source_ref", ["ts", "seq"], S.OPS_PER_TASK, "seq")
             .withColumn("__gl_adm", F.lit(True)))
    out = (v.join(first, "seq", "left")
           .withColumn("budget_ok", F.col("valid") & (F.col("source_ref").isNull() | F.col("__gl_adm").isNotNull()))
           .drop("__gl_adm"))
    code = (F.when(F.col("parse_error").isNotNull(), F.lit("bad_query"))
            .when(~F.col("valid"), F.lit("validation_failed"))
            .when(~F.col("budget_ok"), F.lit("budget_exhausted"))
            .otherwise(F.lit("admitted")))
    return out.withColumn("code", code)


def refusals(admitted: DataFrame) -> DataFrame:
    """``seq, code, response`` of the lines that admission turned away; the trace id is known from the budget on."""
    message = (F.when(F.col("parse_error") == "too_large", F.lit("request line too large"))
               .when(F.col("code") == "bad_query", F.lit("invalid JSON"))
               .when(F.col("code") == "validation_failed", F.col("errors"))
               .otherwise(F.concat(F.lit("source_ref "), F.col("source_ref"),
                                   F.lit(f" exceeded WEB_OPS_PER_TASK ({S.OPS_PER_TASK})"))))
    trace = F.when(F.col("code") == "budget_exhausted", F.col("trace_id"))
    line = F.to_json(F.struct(F.lit(False).alias("ok"), "code", message.alias("message"), trace.alias("trace_id")))
    return admitted.filter(F.col("code") != "admitted").select("seq", "code", line.alias("response"))


def serve(lines: DataFrame, allowlist: DataFrame, snapshot: DataFrame, crawl: DataFrame, payloads: DataFrame) -> DataFrame:
    """``seq, code, response`` for every non-blank line. ``payloads``: saved upstream answers by seq."""
    a = materialize(admit(lines, FIELDS), "admitted-requests")
    good = a.filter(F.col("code") == "admitted")
    fetch = good.filter(F.col("contract_id_raw") == S.CONTRACT_FETCH).select(
        "seq", F.col("ts").alias("now"), "url", F.col("caller_agent_id").alias("requesting_agent_id"),
        F.col("source_ref").alias("task_id"), (F.col("freshness") == "realtime").alias("bypass_cache"), "trace_id")
    fetched = FP.fetch_pipeline(fetch, allowlist, snapshot, crawl)
    search = good.filter(F.col("contract_id_raw") == S.CONTRACT_SEARCH).select(
        "seq", F.col("ts").alias("now"), "query", "top_n", "freshness", "site_filter", "caller_agent_id", "source_ref", "trace_id")
    found = SP.search_pipeline(search, payloads, allowlist)
    return (refusals(a)
            .union(fetched.outcomes.select("seq", "code").join(FP.responses(fetched), "seq").select("seq", "code", "response"))
            .union(found.outcomes.select("seq", "code").join(SP.responses(found), "seq").select("seq", "code", "response")))
