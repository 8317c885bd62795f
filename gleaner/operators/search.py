"""Search operators: saved-payload scan (O3), result normalisation (O11), site_filter check (O18),
site_filter narrowing (O19), top-N (O29) and the search provenance row (O35 + O33).

Payloads are saved upstream responses (the live API call is not made): ``(request key, http_status,
payload_json)``. ``payload.web.results ?? []`` is read through VARIANT and exploded with its rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions import urls as U
from . import allowlist as A


def _one_value(text) -> Column:
    """The text as VARIANT if it is exactly one JSON value, else NULL (the parser alone stops after the first).
    Wrapped in an array and in an object, trailing text breaks at least one of the two."""
    as_list = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    as_field = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$", "map<string,variant>")
    return F.when((F.size(as_list) == 1) & (F.size(F.map_keys(as_field)) == 1), as_list[0])


def parse_payloads(payloads: DataFrame, payload_col: str = "payload_json", out_col: str = "payload") -> DataFrame:
    """Add ``out_col``: the payload as VARIANT, NULL unless it is one JSON value. The scan and both error checks read it."""
    return payloads.withColumn(out_col, _one_value(F.col(payload_col)))


def scan_results(payloads: DataFrame, key: str = "seq", payload: str = "payload", carry: tuple = ()) -> DataFrame:
    """One row per entry of ``web.results`` of a parsed payload with its 0-based ``rank``, the columns to ``carry`` and the
    three fields when they are JSON strings (``is_wellformed`` = all three are strings). Payloads that did not parse
    produce nothing."""
    res = F.try_variant_get(F.col(payload), "$.web.results", "array<variant>")
    e = payloads.select(key, *carry, F.posexplode(F.coalesce(res, F.array().cast("array<variant>"))).alias("rank", "r"))

    def field(name):
        f = F.try_variant_get(F.col("r"), f"$.{name}", "variant")
        return F.when(F.schema_of_variant(f) == "STRING", F.try_variant_get(f, "$", "string"))

    return (e.select(key, *carry, F.col("rank").cast("int").alias("rank"), field("title").alias("title"),
                     field("url").alias("url"), field("description").alias("description"))
            .withColumn("is_wellformed", F.col("title").isNotNull() & F.col("url").isNotNull()
                        & F.col("description").isNotNull()))


def upstream_error(status_col: str = "http_status", payload: str = "payload"):
    """Upstream failure message (NULL when the payload is usable): non-2xx status or invalid JSON."""
    st = F.col(status_col)
    return (F.when((st < 200) | (st >= 300), F.concat(F.lit("brave_search: brave_search_http_"), st.cast("string")))
            .when(F.col(payload).isNull(), F.lit("brave_search: brave_search_invalid_json")))


def handler_error(payload: str = "payload") -> Column:
    """Whether a valid JSON payload makes the service's handler throw: the payload or one of its results is ``null``, or
    ``web.results`` is something that cannot be iterated (a missing or null list is an empty one, text is skipped)."""
    v = F.col(payload)
    results = F.try_variant_get(v, "$.web.results", "variant")
    kind = F.schema_of_variant(results)
    holes = F.exists(F.try_variant_get(results, "$", "array<variant>"), lambda r: r.isNull() | F.is_variant_null(r))
    odd = results.isNotNull() & ~F.is_variant_null(results) & ~kind.startswith("ARRAY") & (kind != "STRING")
    return F.coalesce(F.is_variant_null(v), F.lit(False)) | F.coalesce(odd, F.lit(False)) | F.coalesce(holes, F.lit(False))


def normalise(results: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Keep well-formed, on-allowlist results; ``description`` becomes ``snippet``."""
    ok = results.filter("is_wellformed")
    cols = [c for c in ok.columns if c not in ("description", "is_wellformed")]
    return A.semi(ok, "url", allowlist).select(*cols, F.col("description").alias("snippet"))


def site_filter_offender(requests: DataFrame, allowlist: DataFrame, key: str = "seq",
                         filter_col: str = "site_filter") -> DataFrame:
    """Per request with a site_filter: the first hostname that is not on the allowlist (subdomains and any
    case accepted), or no row when all pass (O18)."""
    hosts = requests.select(key, F.posexplode(filter_col).alias("pos", "host"))
    probe = hosts.withColumn("__gl_u", F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
    off = A.anti(probe, "__gl_u", allowlist)
    return off.groupBy(key).agg(F.min_by("host", "pos").alias("offender"))


def narrow(results: DataFrame, requests: DataFrame, key: str = "seq", filter_col: str = "site_filter") -> DataFrame:
    """Keep a result only when its exact hostname is in the request's site_filter (no subdomains, the filter
    is not lower-cased); a NULL filter keeps everything; an unparsable url is dropped (O19)."""
    return narrowed(results.join(requests.select(key, filter_col), key), filter_col)


def narrowed(results: DataFrame, filter_col: str = "site_filter") -> DataFrame:
    """``narrow`` for results that carry their request's site_filter; the column goes."""
    host = U.hostname("url")
    keep = F.col(filter_col).isNull() | (host.isNotNull() & F.array_contains(F.col(filter_col), host))
    return results.filter(keep).drop(filter_col)


def top_n(results: DataFrame, n_col: str = "top_n", key: str = "seq", rank_col: str = "rank") -> DataFrame:
    """First ``top_n`` results per request in upstream rank order (O29). A request's group is bounded by the
    upstream page size (it was asked for ``top_n`` results), so the per-request window stays small."""
    w = Window.partitionBy(key).orderBy(rank_col)
    return (results.withColumn("result_rank", F.row_number().over(w))
            .filter(F.col("result_rank") <= F.col(n_col)))


def search_url(query, top_n_col, freshness) -> F.Column:
    """``brave-search://<encodeURIComponent(query)>?top_n=..&freshness=..``."""
    return F.concat(F.lit(S.SEARCH_URL_SCHEME), X.uri_component(query), F.lit("?top_n="),
                    top_n_col.cast("string"), F.lit("&freshness="), freshness)


def search_sha(query, top_n_col, freshness) -> F.Column:
    """sha256 of ``query:top_n:freshness``."""
    return X.sha256_hex(F.concat_ws(":", query, top_n_col.cast("string"), freshness))
