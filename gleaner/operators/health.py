"""Domain-health verdict from a probe log.

All DNS checks precede all HEAD checks: the verdict is the first entry (by ``entry_index``) failing DNS
(no A and no AAAA record, or a DNS error), else the first failing HEAD (transport error, or status < 200 or
>= 400; 3xx passes; AAAA alone passes). One ``min_by`` per group over failing entries, so a group of any size
is reduced by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

CAUSE_SEP = " | "


def probe_failures(probes: DataFrame) -> DataFrame:
    """Per entry: ``phase`` (0 dns, 1 head, NULL ok), ``kind``, ``upstream_error``."""
    a, aaaa = F.coalesce("a_count", F.lit(0)), F.coalesce("aaaa_count", F.lit(0))
    dns_err, head_err, st = F.col("dns_error"), F.col("head_error"), F.col("head_status")
    kind = (F.when(dns_err.isNotNull(), F.lit("dns_error"))
            .when((a == 0) & (aaaa == 0), F.lit("dns_empty"))
            .when(head_err.isNotNull(), F.lit("head_error"))
            .when(st.isNull() | (st < 200) | (st >= 400), F.lit("head_status")))
    upstream = (F.when(kind == "dns_error", dns_err).when(kind == "dns_empty", F.lit(S.DNS_EMPTY_ERROR))
                .when(kind == "head_error", head_err)
                .when(kind == "head_status", F.concat(F.lit("HTTP "), F.coalesce(st.cast("string"), F.lit("0")))))
    phase = F.when(kind.startswith("dns"), F.lit(0)).when(kind.isNotNull(), F.lit(1))
    return probes.select("*", phase.alias("phase"), kind.alias("kind"), upstream.alias("upstream_error"))


def causes(kind) -> F.Column:
    m = F.create_map(*[x for k, v in S.HEALTH_CAUSES.items() for x in (F.lit(k), F.lit(CAUSE_SEP.join(v)))])
    return F.element_at(m, kind if not isinstance(kind, str) else F.col(kind))


def verdict(probes: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """One row per group: ``status ('ok'|'fail'), step, dependency, upstream_error, entry_index, ranked_causes``."""
    group_cols = group_cols or []
    f = probe_failures(probes)
    bad = F.when(F.col("phase").isNotNull(),
                 F.struct(F.col("phase"), F.col("entry_index"), F.col("domain"), F.col("kind"), F.col("upstream_error")))
    g = f.groupBy(*group_cols) if group_cols else f.groupBy()
    agg = g.agg(F.min(bad).alias("v"))
    v = F.col("v")
    return agg.select(*group_cols,
                      F.when(v.isNull(), F.lit("ok")).otherwise(F.lit("fail")).alias("status"),
                      F.when(v.phase == 0, F.lit("dns")).when(v.phase == 1, F.lit("head")).alias("step"),
                      v.domain.alias("dependency"), v.upstream_error.alias("upstream_error"),
                      v.entry_index.cast("long").alias("entry_index"), causes(v.kind).alias("ranked_causes"))
