"""Allowlist operators: entry validation (O9), TTL class lookup (O15), membership (O16) and
longest-suffix lookup (O17).

Plan shape. The suffix theta-join ``host = d or host endswith '.'||d`` becomes an equi-join: every *distinct*
host is exploded to its parent domains (a handful of short strings), these are joined with the allowlist on
equality, the longest match per host is kept (``max_by``), and the result goes back to the rows by host. What is
shuffled before the last join are distinct hosts only. No size is guessed or remembered: Spark broadcasts the
sides that its own statistics show to be small, and AQE splits a hot host's partition where it can't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import urls as U

ENTRY_FIELDS = ["entry_index", "domain", "purpose", "ttl_class", "added_at"]

def ttl_seconds(ttl_class) -> Column:
    """TTL class -> seconds (O15); NULL for an unknown class."""
    c = F.col(ttl_class) if isinstance(ttl_class, str) else ttl_class
    m = F.create_map(*[x for k, v in S.TTL_SECONDS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return F.element_at(m, c)


def entry_error(al: DataFrame) -> DataFrame:
    """Per entry, the first broken rule in the service's order (O9); NULL when the entry is valid.
    ``added_at`` must be ``YYYY-MM-DD`` and a real calendar date (stricter than a JS engine, documented)."""
    d, p, t, a = (F.col(c) for c in ("domain", "purpose", "ttl_class", "added_at"))
    err = (F.when(d.isNull() | ~d.rlike(S.DOMAIN_PATTERN), F.lit("domain"))
           .when(p.isNull() | (F.length(p) == 0), F.lit("purpose"))
           .when(t.isNull() | ~t.isin(*S.TTL_CLASSES), F.lit("ttl_class"))
           .when(a.isNull() | ~a.rlike(S.ISO_DATE_PATTERN), F.lit("added_at"))
           .when(F.expr("try_cast(added_at as date)").isNull(), F.lit("added_at_date")))
    return al.withColumn("error", err)


def validate(al: DataFrame) -> DataFrame:
    """Table verdict (O9): one row ``(n_entries, ok, bad_index, bad_rule, message)``; the first failing
    entry by index wins. An empty table fails with ``entries is empty``."""
    e = entry_error(al)
    agg = e.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.min_by(F.struct("entry_index", "error", "domain"),
                 F.when(F.col("error").isNotNull(), F.col("entry_index"))).alias("bad"),
    )
    bad = F.col("bad")
    msg = (F.when(F.col("n_entries") == 0, F.lit('"entries" is empty'))
           .when(bad.isNull(), F.lit(None).cast("string"))
           .when(bad.error == "domain", F.format_string('entry %d has invalid "domain"', bad.entry_index))
           .when(bad.error == "added_at_date",
                 F.format_string('entry %d ("%s") "added_at" is not a real date', bad.entry_index, bad.domain))
           .otherwise(F.format_string('entry %d ("%s") has invalid "%s"', bad.entry_index, bad.domain, bad.error)))
    return agg.select(
        F.col("n_entries").cast("long").alias("n_entries"),
        ((F.col("n_entries") > 0) & bad.isNull()).alias("ok"),
        bad.entry_index.cast("long").alias("bad_index"),
        bad.error.alias("bad_rule"),
        msg.alias("message"),
    )


def _first_per_domain(al: DataFrame) -> DataFrame:
    # equal domains: the first one in the file wins (strict '>' on length in the service)
    return (al.groupBy("domain")
            .agg(F.min_by(F.struct(*ENTRY_FIELDS), F.col("entry_index")).alias("e"))
            .select("e.*"))


def host_entries(df: DataFrame, url_col: str, allowlist: DataFrame) -> DataFrame:
    """``__gl_host, __gl_best``: the longest matching entry of every distinct host of ``url_col`` that is on the list."""
    al = _first_per_domain(allowlist.select(*ENTRY_FIELDS))
    host = "__gl_host"
    hosts = df.select(U.hostname(F.col(url_col)).alias(host)).distinct().filter(F.col(host).isNotNull())
    cand = hosts.select(host, F.explode(U.suffix_candidates(F.col(host))).alias("domain"))
    return (cand.join(al, "domain")
            .filter((F.size(F.split("domain", r"\.")) >= 2) | (F.col("domain") == F.col(host)))
            .groupBy(host)
            .agg(F.max_by(F.struct(*ENTRY_FIELDS),
                          F.struct(F.length("domain"), -F.col("entry_index"))).alias("__gl_best")))


def lookup(df: DataFrame, url_col: str, allowlist: DataFrame, prefix: str = "al_", entries: DataFrame | None = None) -> DataFrame:
    """Add ``{prefix}entry_index, {prefix}domain, {prefix}purpose, {prefix}ttl_class, {prefix}added_at`` of the
    longest matching allowlist entry for ``url_col`` (all NULL when off-list) plus ``{prefix}ttl_seconds``.

    Membership follows the service: exact host, or a parent domain with at least two labels; an unparsable
    url never matches; the host is lower-cased, the domain is compared as written.

    ``entries``: the ``host_entries`` of ``df``, if they are kept already. Spark knows the size of a kept table before it
    plans, so wide rows are not moved by their host for a few entries.
    """
    host = "__gl_host"
    best = host_entries(df, url_col, allowlist) if entries is None else entries
    out = df.withColumn(host, U.hostname(F.col(url_col))).join(best, host, "left")
    cols = [F.col(f"__gl_best.{f}").alias(prefix + f) for f in ENTRY_FIELDS]
    return (out.select("*", *cols)
            .withColumn(prefix + "ttl_seconds", ttl_seconds(F.col(prefix + "ttl_class")))
            .drop("__gl_best", host))


def semi(df: DataFrame, url_col: str, allowlist: DataFrame) -> DataFrame:
    """Rows whose url is on the allowlist (O16, semi)."""
    cols = df.columns
    return lookup(df, url_col, allowlist, prefix="__gl_s_").filter(F.col("__gl_s_domain").isNotNull()).select(*cols)


def anti(df: DataFrame, url_col: str, allowlist: DataFrame) -> DataFrame:
    """Rows whose url is not on the allowlist (O16, anti)."""
    cols = df.columns
    return lookup(df, url_col, allowlist, prefix="__gl_s_").filter(F.col("__gl_s_domain").isNull()).select(*cols)
