"""Budgets and quotas: per-task op cap (O27/O26), declared daily cap (D4) and monthly spend.

Per-task cap: among *valid* envelopes, the first ``cap`` per ``source_ref`` in arrival order pass. A denial
never changes the counter, so "rank <= cap" is exactly the service's sequential counter. The rank filter is
planned by Spark as a WindowGroupLimit *before* the shuffle (at most ``cap`` rows per key leave each map
task), so a source_ref holding a third of all rows never lands whole in one task. The admitted ids are joined
back on the unique arrival id, which is skew-free.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def first_k_ids(df: DataFrame, key: str, order: list[str], k: int, id_col: str) -> DataFrame:
    """``id_col`` of the first ``k`` rows per ``key`` (rows with a NULL key excluded)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (df.filter(F.col(key).isNotNull())
            .select(key, id_col, *[c for c in order if c != id_col])
            .withColumn("__gl_rank", F.row_number().over(w))
            .filter(F.col("__gl_rank") <= k)
            .select(id_col))


def task_budget(valid: DataFrame, key: str = "source_ref", order=("ts", "seq"), cap: int = S.OPS_PER_TASK,
                id_col: str = "seq") -> DataFrame:
    """Add ``budget_ok``: True for the first ``cap`` rows per key (NULL key: unlimited)."""
    order = list(order)
    admitted = first_k_ids(valid, key, order, cap, id_col).withColumn("__gl_adm", F.lit(True))
    return (valid.join(admitted, id_col, "left")
            .withColumn("budget_ok", F.col(key).isNull() | F.col("__gl_adm").isNotNull())
            .drop("__gl_adm"))


def ops_per_task(df: DataFrame, key: str = "source_ref") -> DataFrame:
    """Per key: valid requests, admitted, denied (partial aggregation, hot keys collapse map-side)."""
    return (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_requests"),
                 F.count(F.when(F.col("budget_ok"), 1)).alias("n_admitted"),
                 F.count(F.when(~F.col("budget_ok"), 1)).alias("n_denied")))


def daily_ops(admitted: DataFrame, ts_col: str = "ts", cap: int = S.OPS_PER_DAY) -> DataFrame:
    """Declared whole-agent daily cap: per UTC day, ops, ops within the cap, ops over it."""
    day = F.date_format(F.col(ts_col).cast("timestamp"), "yyyy-MM-dd")
    return (admitted.groupBy(day.alias("day"))
            .agg(F.count(F.lit(1)).alias("n_ops"))
            .withColumn("n_within_cap", F.least(F.col("n_ops"), F.lit(cap).cast("long")))
            .withColumn("n_over_cap", F.col("n_ops") - F.col("n_within_cap")))


def daily_cap(admitted: DataFrame, ts_col: str = "ts", id_col: str = "seq", cap: int = S.OPS_PER_DAY) -> DataFrame:
    """Declared whole-agent daily cap per op: the first ``cap`` ops of each UTC day (arrival order) are within it.
    A day is one group, so the rank filter runs as a group limit before the shuffle (at most ``cap`` rows per
    day leave each map task)."""
    df = admitted.withColumn("day", F.date_format(F.col(ts_col).cast("timestamp"), "yyyy-MM-dd"))
    ok = first_k_ids(df, "day", [ts_col, id_col], cap, id_col).withColumn("__gl_ok", F.lit(True))
    return df.join(ok, id_col, "left").withColumn("within_cap", F.col("__gl_ok").isNotNull()).drop("__gl_ok")


def monthly_spend(searches: DataFrame, ts_col: str = "ts", usd_per_search: str = S.USD_PER_SEARCH,
                  budget_usd: str = S.BUDGET_USD_MONTH) -> DataFrame:
    """Declared monthly search budget: per UTC month, searches, spend (decimal), searches within budget."""
    per = Decimal(usd_per_search)
    within = int(Decimal(budget_usd) / per)
    month = F.date_format(F.col(ts_col).cast("timestamp"), "yyyy-MM")
    spend = (F.col("n_searches").cast("decimal(18,0)") * F.lit(per).cast("decimal(18,6)")).cast("decimal(18,6)")
    return (searches.groupBy(month.alias("month"))
            .agg(F.count(F.lit(1)).alias("n_searches"))
            .withColumn("spend_usd", spend)
            .withColumn("n_within_budget", F.least(F.col("n_searches"), F.lit(within).cast("long")))
            .withColumn("exhausted", F.col("spend_usd") > F.lit(Decimal(budget_usd)).cast("decimal(18,6)")))


def spend_running(searches: DataFrame, ts_col: str = "ts", id_col: str = "seq",
                  usd_per_search: str = S.USD_PER_SEARCH, budget_usd: str = S.BUDGET_USD_MONTH) -> DataFrame:
    """Per search: whether it still fits the month's budget (rank in the month * cost <= budget).

    No month is ranked in one task: searches are counted per month and hour (partial aggregation, a few hundred
    hours a month), a running count over the hours tells which hour the budget ends in, and only that hour's
    searches are ranked."""
    per = Decimal(usd_per_search)
    within = int(Decimal(budget_usd) / per)
    ts = F.col(ts_col).cast("timestamp")
    df = searches.withColumn("month", F.date_format(ts, "yyyy-MM")).withColumn("__gl_hour", F.date_trunc("hour", ts))
    earlier = Window.partitionBy("month").orderBy("__gl_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = df.groupBy("month", "__gl_hour").agg(F.count(F.lit(1)).alias("__gl_n"))
    hours = hours.withColumn("__gl_base", F.coalesce(F.sum("__gl_n").over(earlier), F.lit(0)))
    df = df.join(hours, ["month", "__gl_hour"])
    split = df.filter((F.col("__gl_base") < within) & (F.col("__gl_base") + F.col("__gl_n") > within))
    ranked = split.withColumn("__gl_rank", F.col("__gl_base") + F.row_number().over(
        Window.partitionBy("month", "__gl_hour").orderBy(ts_col, id_col)))
    last = ranked.filter(F.col("__gl_rank") <= within).select(id_col, F.lit(True).alias("__gl_ok"))
    ok = (F.col("__gl_base") + F.col("__gl_n") <= within) | F.col("__gl_ok").isNotNull()
    return (df.join(last, id_col, "left").withColumn("within_budget", F.coalesce(ok, F.lit(False)))
            .drop("__gl_ok", "__gl_hour", "__gl_n", "__gl_base"))
