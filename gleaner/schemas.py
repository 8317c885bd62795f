"""Explicit schemas and the fixed values every job shares.

Schemas are declared, never inferred. The constants below must equal the service contract's values for
results to agree; they are written out plainly in one place.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the reference contract; do not tune)
# ---------------------------------------------------------------------------------------------
TTL_SECONDS = {"insurance-med": 86400, "airline": 3600, "generic": 604800}
OPS_PER_TASK = 5
OPS_PER_DAY = 50
BUDGET_USD_MONTH = "5"
USD_PER_SEARCH = "0.003"
MAX_BODY_BYTES = 200000
MAX_REQUEST_LINE_BYTES = 1048576
DEFAULT_TOP_N = 5
DEFAULT_SEARCH_FRESHNESS = "any"
DEFAULT_FETCH_FRESHNESS = "cached"

CONTRACT_SEARCH = "web.search.v1"
CONTRACT_FETCH = "web.fetch.v1"
SEARCH_FRESHNESS = ["any", "day", "week", "month", "year"]
FETCH_FRESHNESS = ["cached", "realtime"]
TOP_N_MIN, TOP_N_MAX = 1, 20
QUERY_MIN_LEN, QUERY_MAX_LEN = 2, 200
SITE_FILTER_MIN, SITE_FILTER_MAX = 1, 10
URL_MAX_LEN = 2048
MAX_BYTES_MIN, MAX_BYTES_MAX = 1024, 200000
COMMON_FIELDS = ["contract_id", "trace_id", "dedupe_key", "source_ref", "caller_agent_id"]
SEARCH_FIELDS = COMMON_FIELDS + ["query", "top_n", "freshness", "site_filter"]
FETCH_FIELDS = COMMON_FIELDS + ["url", "freshness", "max_bytes"]

TRACE_ID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
DOMAIN_PATTERN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+\z"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
TTL_CLASSES = ["insurance-med", "airline", "generic"]

TITLE_CAPTCHA_PATTERN = r"(?i)\b(sign[-\s]?in|log[-\s]?in|access denied|captcha)\b"
BODY_CAPTCHA_PATTERN = r"(?i)captcha|are you human|recaptcha|cloudflare ray id"
BODY_PREFIX_SCAN_CHARS = 500
MIN_USEFUL_PLAINTEXT_CHARS = 200
LOW_SIGNAL_SHA_PREFIX = "__low_signal__:"

SEARCH_URL_SCHEME = "brave-search://"
UNTRUSTED_OPEN = "<UNTRUSTED_WEB"
UNTRUSTED_CLOSE = "</UNTRUSTED_WEB>"
UNTRUSTED_CLOSE_ESCAPED = "<!- UNTRUSTED_WEB-ESCAPED -!>"

PROVENANCE_KINDS = ["search", "fetch"]

# Outcome and reason vocabularies.
OUTCOMES = ["ok", "cache_hit", "low_signal", "off_allowlist"]
FETCH_REASONS = ["over_size_cap", "non_2xx", "timeout", "invalid_content_type", "transport_error"]
EXTRACT_REASONS = ["captcha_or_paywall", "empty", "parse_error"]
RESPONSE_CODES = ["bad_query", "validation_failed", "budget_exhausted", "not_allowlisted", "low_signal",
                  "upstream_error", "handler_error"]

# Boot health verdict: ranked causes per failure kind, in the order the service lists them.
HEALTH_CAUSES = {
    "dns_empty": ["domain decommissioned or renamed",
                  "allowlist entry typo",
                  "DNS resolver transient outage (re-run boot-check after 30s)"],
    "dns_error": ["domain decommissioned or renamed",
                  "DNS resolver transient outage",
                  "host-side network filter blocking DNS"],
    "head_error": ["host unreachable / TCP-level outage",
                   "HEAD probe blocked by WAF (try GET in sub-item 3, but only at fetch time, not at boot)",
                   "transient transport hiccup (re-run boot-check after 30s)"],
    "head_status": ["domain decommissioned (5xx persistent)",
                    "HEAD blocked by WAF (try GET when sub-item 3 ships; do not rewrite boot probe)",
                    "transient outage (re-run boot-check after 30s)"],
}
DNS_EMPTY_ERROR = "ENOTFOUND (no A or AAAA records)"

# ---------------------------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------------------------
ALLOWLIST = T.StructType([
    T.StructField("entry_index", T.IntegerType()),
    T.StructField("domain", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("ttl_class", T.StringType()),
    T.StructField("added_at", T.StringType()),
])

FETCHED_PAGES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("content_sha256", T.StringType()),
    T.StructField("plaintext", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("ttl_seconds", T.LongType()),
    T.StructField("low_signal", T.BooleanType()),
    T.StructField("byte_size", T.LongType()),
])

PROVENANCE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("content_sha256", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("requesting_agent_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("kind", T.StringType()),
])

CRAWL = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("error_name", T.StringType()),
    T.StructField("final_url", T.StringType()),
])

PROBE = T.StructType([
    T.StructField("entry_index", T.IntegerType()),
    T.StructField("domain", T.StringType()),
    T.StructField("a_count", T.IntegerType()),
    T.StructField("aaaa_count", T.IntegerType()),
    T.StructField("dns_error", T.StringType()),
    T.StructField("head_status", T.IntegerType()),
    T.StructField("head_error", T.StringType()),
])

REQUEST_LINE = T.StructType([T.StructField("value", T.StringType())])
HANDLER_ERROR_MESSAGE = "handler exception (logged)"
