"""Request envelopes: line source (O1), contract validation (O8) and declared dedupe keys.

Parsing is strict single-value JSON: ``try_parse_json`` alone accepts trailing text (``{} x``), so the line is
also parsed wrapped as ``[line]`` and ``{"v":line}``; both must parse to exactly one element / one key.
Of equal object keys the last one counts, as in JavaScript: ``parse_lines`` tells the session so
(``spark.sql.variant.allowDuplicateKeys``). A line over the size cap is never parsed.

Validation is one pass of Column predicates over the VARIANT (no UDF). ``errors`` lists stable rule ids in a
fixed order, joined by ``'; '``; the service prints its validator's message text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions import urls as U

HOSTNAME_PATTERN = r"(?i)^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*\.?\z"
URI_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s\x{00A0}<>\"{}|\\^`]*\z"
NUMBER_TYPE = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)\z"


def parse_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Drop blank lines; add ``parse_error`` (NULL | 'too_large' | 'invalid_json') and ``envelope`` (VARIANT).

    Each parse is its own column and later columns reference it (an inline expression reused in two columns
    would be evaluated once per use); the envelope is element 0 of the array-wrapped parse."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    v = F.col(value_col)
    cols = lines.columns
    # The array-wrapped parse can only stop early (and ignore trailing text) at a ']' inside the line, so the
    # object-wrapped parse that catches that case is needed only for lines containing ']'.
    needs_obj = v.contains("]")
    sized = (lines.filter(F.length(X.js_trim(v)) > 0)
             .withColumn("__gl_big", F.octet_length(v) > S.MAX_REQUEST_LINE_BYTES))
    fits = F.when(~F.col("__gl_big"), v)
    staged = sized.select(
        "*", F.try_parse_json(F.concat(F.lit("["), fits, F.lit("]"))).alias("__gl_arr"),
        F.when(needs_obj, F.try_parse_json(F.concat(F.lit('{"v":'), fits, F.lit("}")))).alias("__gl_obj"))
    obj_ok = F.size(F.map_keys(F.try_variant_get("__gl_obj", "$", "map<string,variant>"))) == 1
    single = ((F.size(F.try_variant_get("__gl_arr", "$", "array<variant>")) == 1)
              & (~needs_obj | F.coalesce(obj_ok, F.lit(False))))
    flags = staged.select(*cols, "__gl_arr", "__gl_big", F.coalesce(single, F.lit(False)).alias("__gl_single"))
    err = F.when(F.col("__gl_big"), F.lit("too_large")).when(~F.col("__gl_single"), F.lit("invalid_json"))
    return flags.select(*cols, err.alias("parse_error"),
                        F.when(~F.col("__gl_big") & F.col("__gl_single"),
                               F.try_variant_get("__gl_arr", "$[0]", "variant")).alias("envelope"))


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _type(v: Column, field: str) -> Column:
    """schema_of_variant of the field; NULL when missing, 'VOID' for JSON null."""
    return F.schema_of_variant(_get(v, field))


def _is_string(t: Column) -> Column:
    return t == "STRING"


def _is_number(t: Column) -> Column:
    return t.rlike(NUMBER_TYPE)


def _num(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "double")


def _str(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "string")


_FIELDS = sorted(set(S.SEARCH_FIELDS + S.FETCH_FIELDS))


def validate(parsed: DataFrame, value_col: str = "value", keep_fields: bool = False) -> DataFrame:
    """Add ``contract_id_raw``, ``errors`` (string, NULL when valid) and ``valid`` to a parsed line table.
    With ``keep_fields`` the string value of every contract field is kept as ``env_<field>`` (NULL when absent
    or not a string), so callers need not navigate the VARIANT again.

    Field types and values are projected once (``__gl_t_*``, ``__gl_s_*``, ``__gl_n_*``) from a single
    map conversion of the envelope, and the rules read those columns, which keeps the expression tree linear
    in the number of rules."""
    v = F.col("envelope")
    # one conversion of the object to map<string,variant>; every field is then a map lookup (cheaper than a
    # path navigation per field). Non-objects give a NULL map, so all fields read as absent.
    staged0 = parsed.select("*", F.try_variant_get(v, "$", "map<string,variant>").alias("__gl_m"))
    m = F.col("__gl_m")
    base = staged0.select(
        "*", F.schema_of_variant(v).alias("__gl_top"),
        F.json_object_keys(F.col(value_col)).alias("__gl_keys"),  # document order, for additional:<k>
        F.try_variant_get(m["site_filter"], "$", "array<variant>").alias("__gl_sf"),
        *[F.schema_of_variant(m[f]).alias(f"__gl_t_{f}") for f in _FIELDS],
        *[F.try_variant_get(m[f], "$", "string").alias(f"__gl_s_{f}") for f in _FIELDS],
        *[F.try_variant_get(m[f], "$", "double").alias(f"__gl_n_{f}") for f in ("top_n", "max_bytes")])

    def t(f):
        return F.col(f"__gl_t_{f}")

    def sv(f):
        return F.col(f"__gl_s_{f}")

    def present(f):
        return t(f).isNotNull()

    def bad_string(f):
        return present(f) & ~_is_string(t(f))

    top = F.col("__gl_top")
    cid = sv("contract_id")
    is_obj = top.startswith("OBJECT")
    is_arr = top.startswith("ARRAY")
    pre = (F.when(~(is_obj | is_arr), F.lit("envelope is not an object"))
           .when(is_arr | ~F.coalesce(_is_string(t("contract_id")), F.lit(False)),
                 F.lit("contract_id missing or not a string"))
           .when(~cid.isin(S.CONTRACT_SEARCH, S.CONTRACT_FETCH),
                 F.concat(F.lit("unknown contract_id '"), cid, F.lit("'"))))
    search = F.coalesce(cid == S.CONTRACT_SEARCH, F.lit(False))
    fetch = F.coalesce(cid == S.CONTRACT_FETCH, F.lit(False))

    rules: list[Column] = []
    for f in S.COMMON_FIELDS[1:]:
        rules.append(F.when(~present(f), F.lit(f"required:{f}")))
    rules.append(F.when(search & ~present("query"), F.lit("required:query")))
    rules.append(F.when(fetch & ~present("url"), F.lit("required:url")))
    for f in S.COMMON_FIELDS[1:]:
        rules.append(F.when(bad_string(f), F.lit(f"type:{f}")))
    rules.append(F.when(_is_string(t("trace_id")) & ~sv("trace_id").rlike(S.TRACE_ID_PATTERN),
                        F.lit("pattern:trace_id")))
    q = sv("query")
    rules.append(F.when(search & bad_string("query"), F.lit("type:query")))
    rules.append(F.when(search & _is_string(t("query")) &
                        ((F.length(q) < S.QUERY_MIN_LEN) | (F.length(q) > S.QUERY_MAX_LEN)), F.lit("length:query")))
    tn = F.col("__gl_n_top_n")
    tn_int = _is_number(t("top_n")) & (tn == F.floor(tn))
    rules.append(F.when(search & present("top_n") & ~tn_int, F.lit("type:top_n")))
    rules.append(F.when(search & tn_int & ((tn < S.TOP_N_MIN) | (tn > S.TOP_N_MAX)), F.lit("range:top_n")))
    fr = sv("freshness")
    rules.append(F.when(present("freshness") & ~_is_string(t("freshness")), F.lit("type:freshness")))
    rules.append(F.when(search & present("freshness") &
                        ~F.coalesce(_is_string(t("freshness")) & fr.isin(*S.SEARCH_FRESHNESS), F.lit(False)),
                        F.lit("enum:freshness")))
    rules.append(F.when(fetch & present("freshness") &
                        ~F.coalesce(_is_string(t("freshness")) & fr.isin(*S.FETCH_FRESHNESS), F.lit(False)),
                        F.lit("enum:freshness")))
    sf = F.col("__gl_sf")
    sf_ok = (t("site_filter").startswith("ARRAY") & (F.size(sf) >= S.SITE_FILTER_MIN)
             & (F.size(sf) <= S.SITE_FILTER_MAX)
             & F.forall(sf, lambda e: (F.schema_of_variant(e) == "STRING")
                        & F.try_variant_get(e, "$", "string").rlike(HOSTNAME_PATTERN)
                        & (F.length(F.try_variant_get(e, "$", "string")) <= 253))
             & (F.size(F.array_distinct(F.transform(sf, lambda e: F.to_json(e)))) == F.size(sf)))
    rules.append(F.when(search & present("site_filter") & ~F.coalesce(sf_ok, F.lit(False)),
                        F.lit("items:site_filter")))
    u = sv("url")
    rules.append(F.when(fetch & bad_string("url"), F.lit("type:url")))
    rules.append(F.when(fetch & _is_string(t("url")) &
                        (~u.rlike(URI_PATTERN) | (F.length(u) > S.URL_MAX_LEN)), F.lit("format:url")))
    mb = F.col("__gl_n_max_bytes")
    mb_int = _is_number(t("max_bytes")) & (mb == F.floor(mb))
    rules.append(F.when(fetch & present("max_bytes") & ~mb_int, F.lit("type:max_bytes")))
    rules.append(F.when(fetch & mb_int & ((mb < S.MAX_BYTES_MIN) | (mb > S.MAX_BYTES_MAX)),
                        F.lit("range:max_bytes")))
    keys = F.col("__gl_keys")
    extra = F.when(search, F.array_except(keys, F.array(*[F.lit(k) for k in S.SEARCH_FIELDS]))) \
        .otherwise(F.array_except(keys, F.array(*[F.lit(k) for k in S.FETCH_FIELDS])))
    extra_rules = F.transform(F.coalesce(extra, F.array().cast("array<string>")),
                              lambda k: F.concat(F.lit("additional:"), k))
    rule_errs = F.array_join(F.concat(F.array_compact(F.array(*rules)), extra_rules), "; ")
    staged = base.select("*", pre.alias("__gl_pre"), rule_errs.alias("__gl_rules"))
    errors = F.when(F.col("__gl_pre").isNotNull(), F.col("__gl_pre")).otherwise(F.nullif(F.col("__gl_rules"), F.lit("")))
    out = (staged
           .withColumn("contract_id_raw", F.when(F.coalesce(_is_string(t("contract_id")), F.lit(False)), cid))
           .withColumn("errors", F.when(F.col("parse_error").isNull(), errors)))
    out = out.withColumn("valid", F.col("parse_error").isNull() & F.col("errors").isNull())
    if keep_fields:
        out = out.select("*", *[F.when(_is_string(t(f)), sv(f)).alias(f"env_{f}") for f in _FIELDS])
    return out.drop(*[c for c in out.columns if c.startswith("__gl_")])


def envelope_fields(df: DataFrame) -> DataFrame:
    """Typed columns of a valid envelope (strings stay NULL when absent)."""
    v = F.col("envelope")
    return (df
            .withColumn("source_ref", _str(v, "source_ref"))
            .withColumn("trace_id", _str(v, "trace_id"))
            .withColumn("caller_agent_id", _str(v, "caller_agent_id"))
            .withColumn("query", _str(v, "query"))
            .withColumn("top_n", F.coalesce(_num(v, "top_n").cast("int"), F.lit(S.DEFAULT_TOP_N)))
            .withColumn("url", _str(v, "url"))
            .withColumn("freshness", _str(v, "freshness"))
            .withColumn("site_filter", F.try_variant_get(v, "$.site_filter", "array<string>")))


def dedupe_key(contract_id, caller, url, query, top_n, freshness, site_filter) -> Column:
    """Declared dedupe key (D1): sha256 of ``caller:contract:url_canonical:freshness`` (fetch) or
    ``caller:contract:query_canonical:top_n:freshness:site_filter|empty`` (search). Canonical query = JS-trimmed,
    lower-cased, whitespace collapsed; site filter joined by ','."""
    c = F.col(contract_id) if isinstance(contract_id, str) else contract_id
    col = (lambda x: F.col(x) if isinstance(x, str) else x)
    qc = F.lower(X.collapse_ws(col(query)))
    sf = F.coalesce(F.array_join(col(site_filter), ","), F.lit("empty")) if site_filter is not None else F.lit("empty")
    fetch_key = F.concat_ws(":", col(caller), c, U.canonical_url(col(url)), col(freshness))
    search_key = F.concat_ws(":", col(caller), c, qc, col(top_n).cast("string"), col(freshness), sf)
    return X.sha256_hex(F.when(c == S.CONTRACT_FETCH, fetch_key).otherwise(search_key))


def key_mismatches(df: DataFrame, declared_col: str = "dedupe_key", key_col: str = "computed_key") -> DataFrame:
    """Rows whose declared dedupe key is missing or differs from the computed one."""
    return df.where(~F.col(declared_col).eqNullSafe(F.col(key_col)))
